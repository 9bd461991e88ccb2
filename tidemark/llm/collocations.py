"""Phrase collocations by suffix-sigma: every phrase count of every language from one sorted pass over truncated suffixes.

Each word occurrence gives one suffix: itself and at most `max_n - 1` words after it within its piece. Tasks count equal
suffixes before anything is shuffled. Suffixes are dealt by language and first word, sorted in reverse lexicographic order, and read
with one stack that holds the open prefixes of the current suffix and their counts: when the next suffix leaves a
prefix, its count is complete. The stack works on whole batches: a prefix ends where neighbours differ, and what the end of a batch leaves
open is carried into the next one. What tasks send to each other is packed: the suffixes of one task for one other, as compressed lines; they are
rows again before they are sorted, so Spark's sort spills where memory ends.

First words with more than 1/`HOT_SHARE` of all occurrences are dealt by their first two words,
such pairs by three, such triples by four; prefixes that are split that way are summed once more at the end. A first pass finds them:
each task names what is frequent in its own parts at a quarter of that share, so what is hot anywhere is found, and only a bounded number of
prefixes is named or taken for hot. So every count is exact, and no task gets more than its share because of one word, pair or triple.

Parts are joined to candidates afterwards: every cut of a candidate looks up the counts of both sides, which are at least the
candidate's and so among the counted phrases. Numbers that may pass 64 bits are decimals.

Defined results: null text is empty; a null language is `und`, together with that language's own rows; repeated rows count as often
as they occur; an empty table, or one without frequent phrases, gives an empty result; ties of cuts go to the smallest first part, ties
of the ranking to the larger count, then the lesser phrase by bytes. Only the named columns are read, so none can clash. Long texts
are split into words piece by piece and are never cut elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_table, text_of
from .shingles import mix

MAX_N = 4
LEAST = 30
SCALE = 2_000_000
#: A phrase goes if a longer candidate has this share (in percent) of its occurrences.
CONTAINED = 80
TOP = 2000
#: A prefix is hot if more than one occurrence in so many begins with it.
HOT_SHARE = 256
#: Texts whose suffixes are counted together before they leave a task.
CHUNK_BYTES = 5 << 20
#: Parts of a language that are ranked before the language is.
RANK_PARTS = 64

#: Between the language and the words of a suffix in one sorted text: the least character, so that prefixes stay together.
JOINT = "\0"
#: Characters that words must not hold there, and what stands for them.
_ESCAPES = (("\x01", "\x01\x02"), (JOINT, "\x01\x01"))

PIECE_END, SPACE, WORD = 2, 1, 0
_CLASS = np.full(256, WORD, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = SPACE
_CLASS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = PIECE_END


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts (none null), with the number of their text and of their piece; pieces are numbered through."""
    texts = pc.binary_join_element_wise(pc.ascii_lower(texts.cast(pa.large_string())), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    kind = _CLASS[data]
    inside = kind == WORD
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))  # each text ends with a piece's end, so words end too
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == PIECE_END, dtype=np.int32)[starts]
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets - offsets[0])))
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = data[inside]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters))
    if len(letters) and letters.min() < 2:
        words = escaped(words)
    return words, text, piece


def escaped(words: pa.Array) -> pa.Array:
    for character, escape in _ESCAPES:
        words = pc.replace_substring(words, character, escape)
    return words


def unescaped(words: pa.Array) -> pa.Array:
    for character, escape in reversed(_ESCAPES):
        words = pc.replace_substring(words, escape, character)
    return words


class Coded:
    """The words of some texts as numbers: `columns` holds each occurrence's language and the words of its suffix, 0 for none."""

    def __init__(self, texts: pa.Array, langs: pa.Array, max_n: int):
        words, text, piece = words_of(texts)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64) + 1
        lang = langs.dictionary_encode()
        self.langs, self.words = lang.dictionary, pa.concat_arrays([pa.array([""], pa.large_string()), coded.dictionary])
        self.columns = [lang.indices.to_numpy().astype(np.int64)[text]]
        for k in range(max_n):
            column, n = np.zeros(len(code), dtype=np.int64), max(0, len(code) - k)
            column[:n] = np.where(piece[k:] == piece[:n], code[k:], 0)
            self.columns.append(column)

    def distinct(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns of the distinct suffixes, in the order of their numbers, and how often each occurs."""
        number, places = _pairs(self.columns[0], self.columns[1])
        for column in self.columns[2:]:
            number, places = _pairs(number, column)
        return [c[places] for c in self.columns], np.bincount(number, minlength=len(places))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each pair (a, b), both non-negative and below 2^31, and one place where each number occurs."""
    _, at, number = np.unique((a << 32) | b, return_index=True, return_inverse=True)
    return number, at


def _narrow(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_of(f"`{text_col}`").alias("text"))


def _by_chunk(of: Callable[[Coded], Iterator[pa.RecordBatch]], max_n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """of, for the texts of a task in parts of about CHUNK_BYTES."""
    chunk = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coded(held: list[pa.RecordBatch]) -> Coded:
            return Coded(pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in held]), pa.concat_arrays([b.column("lang").cast(pa.string()) for b in held]), max_n)

        held, size = [], 0
        for batch in batches:
            before = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:  # rows that fill the part, one at least
                done = int(before[first - 1]) if first else 0
                last = min(batch.num_rows, max(first, int(np.searchsorted(before, done + chunk - size))) + 1)
                held.append(batch.slice(first, last - first))
                size += int(before[last - 1]) - done
                first = last
                if size >= chunk:
                    yield from of(coded(held))
                    held, size = [], 0
        if held:
            yield from of(coded(held))
        pa.default_memory_pool().release_unused()

    return run


def frequent_prefixes(docs: DataFrame, max_n: int, share: int) -> DataFrame:
    """words, lang, prefix, n: prefixes of fewer than max_n words that a part of a task's texts has more often than one in 4 * share, by part; with 0 words, all its words."""

    def find(own: Coded) -> Iterator[pa.RecordBatch]:
        lang, *columns = own.columns
        least = len(lang) // (4 * share)
        number, rows = np.bincount(lang, minlength=len(own.langs)), np.arange(len(lang))
        out = [(0, own.langs[i].as_py(), "", int(c)) for i, c in enumerate(number) if c]
        key = lang
        for m, column in enumerate(columns[:-1], 1):
            filled = column[rows] > 0
            rows, key = rows[filled], key[filled]
            key, at = _pairs(key, column[rows])
            n = np.bincount(key, minlength=len(at))
            for i in np.flatnonzero(n > least):
                words = [own.words[int(c[rows[at[i]]])].as_py() for c in columns[:m]]
                out.append((m, own.langs[int(lang[rows[at[i]]])].as_py(), " ".join(words), int(n[i])))
            kept = (n > least)[key]
            rows, key = rows[kept], key[kept]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["words", "lang", "prefix", "n"])

    return docs.mapInArrow(_by_chunk(find, max_n), "words int, lang string, prefix string, n long")


def _split(columns: list[np.ndarray], own: Coded, hot: list[list[tuple[str, list[str]]]]) -> np.ndarray:
    """Of each distinct suffix, sorted by number, how many words its longest hot prefix has."""
    code = {w: i for i, w in enumerate(own.words.to_pylist())} if any(hot) else {}
    lang = {x: i for i, x in enumerate(own.langs.to_pylist())}
    split = np.zeros(len(columns[0]), dtype=np.int64)
    for m, prefixes in enumerate(hot, 1):
        for name, words in prefixes:
            wanted = [lang.get(name), *[code.get(w) for w in words]]
            if None in wanted:
                continue
            low, high = 0, len(split)
            for column, value in zip(columns, wanted, strict=False):
                low, high = low + np.searchsorted(column[low:high], value), low + np.searchsorted(column[low:high], value, side="right")
            split[low:high] = m
    return split


def dealt_suffixes(docs: DataFrame, hot: list[list[tuple[str, list[str]]]], parts: int, max_n: int) -> DataFrame:
    """deal, lang, rows, bytes, suffixes, n, split: the counted suffixes of a part of a task's texts for one of `parts` tasks, as compressed lines of words and compressed numbers."""

    def pack(own: Coded) -> Iterator[pa.RecordBatch]:
        columns, n = own.distinct()
        split = _split(columns, own, hot)
        seeds = [np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names.to_pylist()], dtype=np.uint64) for names in (own.langs, own.words)]
        deal = mix(seeds[0][columns[0]] + np.uint64(1))
        for m, column in enumerate(columns[1:]):
            deal = np.where(split >= m, mix(deal * np.uint64(31) + seeds[1][column]), deal)
        deal = (deal % np.uint64(parts)).astype(np.int64)
        order = np.argsort(deal * len(own.langs) + columns[0], kind="stable")
        key = pc.binary_join_element_wise(*[own.words.take(pa.array(c[order])) for c in columns[1:]], pa.scalar(JOINT, pa.large_string()))
        lines = pc.binary_join_element_wise(key, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        n, split = n[order].astype(np.int64), split[order].astype(np.int8)
        bounds = np.frombuffer(lines.buffers()[1], dtype=np.int64)
        deal, lang = deal[order], columns[0][order]
        starts = np.flatnonzero(np.concatenate([[True], (deal[1:] != deal[:-1]) | (lang[1:] != lang[:-1])])) if len(deal) else np.empty(0, np.int64)
        ends = np.concatenate([starts[1:], [len(deal)]])
        data, codec = lines.buffers()[2], pa.Codec("zstd")
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for a, b in zip(starts, ends, strict=False):
            raw = data.slice(int(bounds[a]), int(bounds[b] - bounds[a]))
            row = [int(deal[a])], [own.langs[int(lang[a])].as_py()], [int(b - a)], [len(raw)], *[[codec.compress(x, asbytes=True)] for x in (raw, n[a:b].tobytes(), split[a:b].tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["deal", "lang", "rows", "bytes", "suffixes", "n", "split"])

    return docs.mapInArrow(_by_chunk(pack, max_n), "deal int, lang string, rows long, bytes long, suffixes binary, n binary, split binary")


def unpacked(dealt: DataFrame) -> DataFrame:
    """suffix (language and words), n, split: the rows of dealt suffixes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for lang, rows, size, *packed in zip(*(batch.column(c) for c in ("lang", "rows", "bytes", "suffixes", "n", "split")), strict=True):
                rows = rows.as_py()
                lines, n, split = (np.frombuffer(codec.decompress(x.as_buffer(), k), dtype=kind) for x, k, kind in zip(packed, (size.as_py(), 8 * rows, rows), (np.uint8, np.int64, np.int8), strict=True))
                ends = np.flatnonzero(lines == 0x0A)
                bounds = np.concatenate([[0], ends - np.arange(rows)])
                suffixes = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(bounds), pa.py_buffer(lines[lines != 0x0A]))
                first = escaped(pa.array([lang.as_py()], pa.large_string()))[0]
                for at in range(0, rows, 20_000):
                    suffix = pc.binary_join_element_wise(first, suffixes.slice(at, 20_000), pa.scalar(JOINT, pa.large_string()))
                    yield pa.RecordBatch.from_arrays([suffix.cast(pa.string()), pa.array(n[at : at + 20_000]), pa.array(split[at : at + 20_000].astype(np.int32))], names=["suffix", "n", "split"])

    return dealt.drop("deal").mapInArrow(unpack, "suffix string, n long, split int")


class Stack:
    """Counts of all prefixes of sorted suffixes, fed batch by batch.

    Only prefixes that reach `least`, or whose first words were split over tasks (`split` of the suffix says how many), are given out.
    """

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least = max_n, least
        self.last: tuple | None = None  # words of the open suffix, language first
        self.open = [0] * max_n  # counts of its prefixes
        self.split = 0

    def close(self, above: int = 0) -> list[tuple]:
        """The open prefixes of more than `above` words, longest first, taken off the stack."""
        rows = []
        for m in range(self.max_n, above, -1):
            if self.last and self.last[m] and (self.open[m - 1] >= self.least or m <= self.split):
                rows.append((self.last[0], " ".join(self.last[1 : m + 1]), m, self.open[m - 1]))
            self.open[m - 1] = 0
        return rows

    def push(self, suffixes: pa.Array, n: np.ndarray, split: np.ndarray) -> tuple[list[tuple], pa.Table]:
        """Takes a batch; gives the prefixes that the stack held and that have ended, and a table of those that began and ended within the batch."""
        size = len(n)
        coded = pc.split_pattern(suffixes, JOINT).flatten().dictionary_encode()
        codes = np.ascontiguousarray(coded.indices.to_numpy().reshape(size, self.max_n + 1).T)
        texts = coded.dictionary
        if pc.any(pc.match_substring(texts, "\x01")).as_py():
            texts = unescaped(texts)
        text = lambda row: tuple(texts[int(c)].as_py() for c in codes[:, row])
        empty = pc.index(texts, "").as_py()
        first, same = text(0), 0  # words that the open suffix shares with the first of the batch, 0 where the language differs
        if self.last and self.last[0] == first[0]:
            while same < self.max_n and first[same + 1] and self.last[same + 1] == first[same + 1]:
                same += 1
        held = self.close(same)
        differs = np.zeros(max(0, size - 1), dtype=bool)
        total = np.concatenate([[0], np.cumsum(n)])
        tables = []
        for m in range(self.max_n + 1):
            differs |= codes[m][1:] != codes[m][:-1]
            if m == 0:
                continue
            starts = np.concatenate([[0], np.flatnonzero(differs) + 1])
            ends = np.concatenate([starts[1:], [size]])
            sums = total[ends] - total[starts]
            if m <= same:  # the first group goes on with what is open
                sums[0] += self.open[m - 1]
            self.open[m - 1] = int(sums[-1])
            given = (codes[m][starts] != empty) & ((sums >= self.least) | (m <= split[starts]))
            given[-1] = False
            at = starts[given]
            lang, *words = (texts.take(pa.array(c[at])) for c in codes[: m + 1])
            phrase = words[0] if m == 1 else pc.binary_join_element_wise(*words, " ")
            tables.append(pa.table({"lang": lang, "phrase": phrase, "words": pa.array(np.full(len(at), m, dtype=np.int32)), "f": pa.array(sums[given].astype(np.int64))}))
        self.last = text(size - 1)
        self.split = int(split[size - 1])
        return held, pa.concat_tables(tables)


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", share: int = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of every phrase of up to max_n words that occurs `least` times; and lang, n: all word occurrences."""
    spark, narrow = docs.sparkSession, _narrow(docs, lang_col, text_col)
    named = cut_table(frequent_prefixes(narrow, max_n, share))
    totals = named.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    whole = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # a hot prefix misses at most 1 / (4 * share) of all occurrences among what was named
    hot = named.filter("words > 0").groupBy("words", "lang", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > whole * 3 / (4 * share)).collect()
    by_length = [[(r["lang"], r["prefix"].split(" ")) for r in hot if r["words"] == m] for m in range(1, max_n)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt_suffixes(narrow, by_length, parts, max_n).repartitionById(parts, "deal")
    dealt = unpacked(dealt).sortWithinPartitions(F.desc("suffix"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, least)
        names = ["lang", "phrase", "words", "f"]
        kinds = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])

        def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            if batch.num_rows:
                held, ended = stack.push(batch.column("suffix"), *[batch.column(c).to_numpy() for c in ("n", "split")])
                yield from out(held)
                yield from ended.to_batches()
        yield from out(stack.close())

    counted = dealt.mapInArrow(count, "lang string, phrase string, words int, f long")
    merged = counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return cut_table(merged), totals


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, contained: int = CONTAINED, top: int = TOP, lang_col: str = "lang", text_col: str = "text", share: int = HOT_SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to max_n words."""
    counts, totals = phrase_counts(docs, max_n, least, lang_col, text_col, share)
    candidates = counts.filter("words > 1").withColumnRenamed("f", "a")
    word = F.split("phrase", " ")
    join_words = lambda first, size: F.concat_ws(" ", F.slice(F.col("__w"), first, size))

    # parts of a candidate that longer candidates cover: each part takes the largest count of a longer phrase
    inside = F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(__w, i, m), ' '))))"))
    longer = candidates.filter("words > 2").withColumn("__w", word).select("lang", inside.alias("phrase"), F.col("a").alias("__f"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("__f").alias("__f"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").filter(F.col("__f").isNull() | (_wide("__f") * 100 < _wide("a") * contained)).drop("__f")

    cuts = kept.withColumn("__w", word).withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", join_words(F.lit(1), F.col("k")).alias("__left"), join_words(F.col("k") + 1, F.col("words") - F.col("k")).alias("__right"))
    left = counts.select("lang", F.col("phrase").alias("__left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("__right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "__left"]).join(right, ["lang", "__right"])
    scored = scored.withColumn("score", F.expr(f"(cast(a as decimal(19,0)) * cast({SCALE} as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = best.withColumn("__part", part).withColumn("__r", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order))).filter(F.col("__r") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


__all__ = ["collocations", "phrase_counts"]
