"""Packing of tokenized documents into fixed windows: best-fit decreasing over a segment tree of remaining capacities.

A document is its token ids and one closing id. It is cut into full windows and one shorter rest; a full window is a
sequence of its own. Rests (with the full windows, as rows of a few numbers, never texts) are dealt by hash to groups of
about `GROUP_DOCS` documents and packed there in order of falling length: a segment tree whose leaves are the remaining
capacities finds the tightest window that is still open. Texts and ids are not shuffled.

Defined results: null text is empty and gives the closing id alone; repeated rows are packed as often as they occur; an
empty table gives an empty result; other columns of the input are ignored, so none can clash.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

WINDOW = 1024
END_ID = 0
#: Documents whose pieces are packed together: enough for little padding, and a few numbers for each piece.
GROUP_DOCS = 4096
#: Texts longer than this are encoded in parts, cut at spaces between ASCII letters, where no token crosses.
LONG_CHARS = 200_000

_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_encoders: dict[tuple[str, str | None], Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a tokenizer file; with the same vocabulary as ranks, by the faster library after comparing the two."""

    def __init__(self, path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if ranks_path is None:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self.encode = lambda text: np.asarray(model.encode(text, add_special_tokens=False).ids, dtype="<u4")
            with open(path, encoding="utf-8") as file:
                self.byte_level = (json.load(file)["pre_tokenizer"] or {}).get("type") == "ByteLevel"
            #: Of each id: does it begin with a space?
            self.after_space = np.array([model.decode([i], skip_special_tokens=False).startswith(" ") for i in range(model.get_vocab_size())])
            return
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = _byte_letters()
        vocab = {bytes(map(letters.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in special}
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        if vocab != ranks or spec["normalizer"] is not None or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{ranks_path} isn't the vocabulary of {path}")
        own = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)
        self.encode = lambda text: own.encode_to_numpy(text, allowed_special=allowed)
        self.byte_level = True
        self.after_space = np.zeros(max(*ranks.values(), *special.values()) + 1, dtype=bool)
        self.after_space[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= LONG_CHARS or not self.byte_level:
            return self.encode(text)
        parts, start = [], 0
        while len(text) - start > LONG_CHARS and (at := _SAFE.search(text, start + LONG_CHARS)):
            parts.append(self.encode(text[start : at.start()]))
            start = at.start()
        return np.concatenate([*parts, self.encode(text[start:])])


def encoder(path: str, ranks_path: str | None) -> Encoder:
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = Encoder(path, ranks_path)
    return _encoders[path, ranks_path]


def cut_pieces(docs: DataFrame, path: str, ranks_path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """A row for each piece of at most `window` ids: doc_id, start, length, doc_tokens, ids_crc32 and, if kept, the ids."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    fields = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "ids_crc32")]
    schema = T.StructType([narrow.schema["doc_id"], *fields, *([T.StructField("ids", T.ArrayType(T.LongType()))] if keep_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path, ranks_path), np.array([END_ID], dtype="<u4")
        for batch in batches:
            rows, ids = [], []
            for i, text in enumerate(batch.column("text")):
                found = np.concatenate([own.ids(text.as_py()), end]).astype("<u4", copy=False)
                for start in range(0, len(found), window):
                    piece = found[start : start + window]
                    rows.append((i, start, len(piece), len(found), zlib.crc32(piece.tobytes())))
                    if keep_ids:
                        ids.append(piece.astype(np.int64))
            table = np.array(rows, dtype=np.int64).reshape(-1, 5)
            columns = [batch.column("doc_id").take(pa.array(table[:, 0])), *[pa.array(table[:, k]) for k in range(1, 5)]]
            if keep_ids:
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int64))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(table[:, 2])]).astype(np.int32)), values))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(cut, schema)


class OpenWindows:
    """A segment tree over remaining capacities 0 to `window`: is any window open with a capacity in this range?"""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.at[capacity].append(which)
        i = capacity + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least `need`, taken out; its capacity and number."""
        some, i = self.some, need + self.size
        while not some[i] and i > 1:
            while i > 1 and i & 1:
                i >>= 1
            if i <= 1:
                return None
            i += 1
            if not some[i]:
                continue
        if i <= 1 or not some[i]:
            return None
        while i < self.size:
            i = 2 * i if some[2 * i] else 2 * i + 1
        capacity = i - self.size
        which = self.at[capacity].pop()
        if not self.at[capacity]:
            some[i] = 0
            while i > 1:
                i >>= 1
                some[i] = some[2 * i] | some[2 * i + 1]
        return capacity, which


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece; lengths in falling order."""
    opened, tree, out, offsets = 0, OpenWindows(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, need in enumerate(lengths.tolist()):
        capacity, which = tree.take_tightest(need) or (window, opened)
        opened += which == opened
        out[k], offsets[k] = which, window - capacity
        if capacity > need:
            tree.add(capacity - need, which)
    return out, offsets


def place(pieces: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """pieces with sequence_id and offset; sequence_id is unique, numbered through within each of the groups."""
    order = [c for c in ("doc_id", "start", "ids_crc32") if pieces.schema[c].dataType.typeName() != "binary"]
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *[(c, "ascending") for c in order]])
        which, offsets = best_fit_decreasing(table.column("length").to_numpy(), window)
        group = key[0].as_py()
        return table.drop_columns(["__group"]).append_column("sequence_id", pa.array(which * groups + group)).append_column("offset", pa.array(offsets))

    # rows that are alike in everything go to different groups by their number
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, path: str, ranks_path: str | None = None, window: int = WINDOW, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their places; with ids, enough to lay out every sequence."""
    groups = max(1, docs.select(f"`{id_col}`").count() // GROUP_DOCS)
    return place(cut_pieces(docs, path, ranks_path, window, id_col, text_col, keep_ids), groups, window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, ids (padded to the window), n_tokens, doc_ids: at most `window` pieces are gathered for a sequence."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    laid = packed.groupBy("sequence_id").agg(ordered.alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.concat(F.flatten(F.col("p.ids")), F.array_repeat(F.lit(pad_id).cast("long"), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return laid.select("sequence_id", ids.alias("ids"), "n_tokens", F.col("p.doc_id").alias("doc_ids"))


def digest(docs: DataFrame, path: str, ranks_path: str | None = None, window: int = WINDOW) -> DataFrame:
    packed = pack_documents(docs, path, ranks_path, window, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
