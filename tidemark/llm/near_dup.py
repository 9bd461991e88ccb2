"""Near-duplicate documents by HyperMinHash, with links confirmed on full shingle sets.

Each text is the set of its distinct five-word shingles. Its sketch has REGISTERS registers: the least hash of a bucket is
kept as its count of leading zeros and MANTISSA bits after them. Equal sets are one node from here on, however many
documents share them. Bands of ROWS registers are keys; nodes that share a key are candidates. Linking is by stars: the
nodes of a key's group are paired with the group's least node, so a group of m nodes gives m - 1 pairs at most; pairs whose
collision-corrected estimate is far below the threshold are dropped, the others are verified on their full sets, and
connected components follow. Where a group then still spans several components, its nodes are joined once more by the
exact prefix join of setjoin, across components only, so a link between two nodes that a star missed is found as well.

Two ways to lose a link are left: a pair at the threshold shares no band with a probability of about (1 - 0.75 ** ROWS) ** BANDS,
3e-6, and its estimate lies DEVIATIONS standard deviations too low with one of about 1e-9.

Defined results: null text, empty text and text without words have the empty set and are linked with nothing; fewer than
five words are one shingle; repeated rows and copies share a component, whose id is its least one; documents without an id
take part and have the id of their component, null if nothing in it has one, and are kept where theirs is null too; an empty table gives an
empty result; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import DEALT, by_size, cut_table, dealt, scratch, shielded, text_of
from .shingles import U, mix, shingle_set

PERCENT = 75
ROWS = 5
BANDS = 48
REGISTERS = ROWS * BANDS
MANTISSA = 10
EMPTY = 0xFFFF
#: Standard deviations below the threshold at which an estimate rules a pair out.
DEVIATIONS = 6
#: Chance that two registers of different sets agree, times 2 ** MANTISSA: the constant of the sketch's published analysis.
COLLISIONS = 0.169919487159739093975315012348 * 4


def sketch(s: np.ndarray) -> np.ndarray:
    """The registers of a set as 16-bit numbers, leading zeros above mantissa."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    if len(s):
        at = (((mix(s ^ U(0x243F6A8885A308D3)) >> U(32)) * U(REGISTERS)) >> U(32)).astype(np.int64)
        value = mix(s ^ U(0x13198A2E03707344)) >> U(11)  # 53 bits: exact as a float
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        least = np.minimum.reduceat(value[order], first).astype(np.float64)
        m, e = np.frexp(least)
        mantissa = np.where(least > 0, (2 * m - 1) * (1 << MANTISSA), 0).astype(np.int64)
        out[at[first]] = ((np.where(least > 0, 53 - e, 54).astype(np.int64) << MANTISSA) | mantissa).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band with a filled register, as signed numbers."""
    rows = registers.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * U(0x9FB21C651E98DF25) + rows[:, k])
    return h[(rows != EMPTY).any(axis=1)].view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of register rows, corrected for chance collisions, and the registers they rest on."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(filled.sum(axis=1), 1)
    chance = n * COLLISIONS / (1 << MANTISSA)
    equal = ((a == b) & filled).sum(axis=1)
    return np.maximum(equal - chance, 0) / np.maximum(n - chance, 1), n


def node_of(s: np.ndarray) -> np.int64:
    """A hash of a whole set."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.add.reduce(mix(s ^ U(0xA4093822299F31D0))) + U(len(s))], dtype=np.uint64)).view(np.int64)[0]


def row_key() -> Column:
    """A hash of a row's id and text, by which rows are found again: ids may be null or repeated."""
    return F.xxhash64("doc_id", text_of())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (its row_key), node (a hash of its set), n_shingles, keys and registers for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, registers = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                r = sketch(s)
                nodes.append(node_of(s))
                sizes.append(len(s))
                keys.append(band_keys(r))
                registers.append(r.astype("<u2").tobytes())
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), listed, pa.array(registers, pa.binary())],
                names=["doc_id", "row", "node", "n_shingles", "keys", "registers"],
            )

    narrow = docs.select("doc_id", row_key().alias("row"), text_of().alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {id_type}, row long, node long, n_shingles long, keys array<long>, registers binary")


def node_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles (signed, sorted) for the rows of wanted (node, row), one for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), listed], names=["node", "shingles"])

    texts = docs.select(row_key().alias("row"), text_of().alias("text")).join(by_size(wanted, 32), "row").select("node", "text")
    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def star_pairs(rows: DataFrame) -> DataFrame:
    """rows (key, node) of groups with two nodes or more, each with the group's least node as center; of groups of the same nodes one."""
    members = {"center": F.min("node"), "last": F.max("node"), "n": F.count("*"), "all": F.bit_xor(F.xxhash64("node"))}
    groups = rows.groupBy("key").agg(*[v.alias(k) for k, v in members.items()]).filter("center != last")
    return rows.hint("merge").join(groups.groupBy(*members).agg(F.min("key").alias("key")).select("key", "center"), "key")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the threshold."""

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [np.frombuffer(b"".join(x.to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for x in (a, b)]
        t, (found, n) = percent / 100, estimate(*rows)
        return pa.array(found >= t - DEVIATIONS * np.sqrt(t * (1 - t) / n) - 1 / n)

    for end in ("a", "b"):
        own = nodes.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("registers").alias(f"r_{end}"))
        pairs = pairs.join(own, end)
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.filter(sizes).filter(near("r_a", "r_b")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.filter(setjoin.similar(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for all ends of links, by alternating large and small stars."""

    def swapped(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        sides = swapped(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = (sides.hint("merge") if many else sides).join(least, "a")
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    edges, before = cut_table(links.filter("a != b")), None
    many = edges.count() > DEALT
    while True:
        edges = cut_table(star(star(edges, True), False))
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def still_open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """node and label (of its component) of the nodes of groups that aren't all of one component."""
    found = cut_table(groups.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    open_keys = found.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    return found.join(open_keys, "key", "left_semi").select("node", "label").distinct()


def linked(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links: those the sketches allow, verified on the sets of their texts."""
    pairs = dealt(cut_table(plausible(pairs, nodes, percent)))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut_table(node_sets(docs, cut_table(ends.join(nodes, "node").select("node", "row"))))
    return dealt(cut_table(verified(pairs, sets, percent)))


def missed_links(docs: DataFrame, left: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links across components between nodes of groups that span several components, by an exact prefix join."""
    sets = cut_table(node_sets(docs, cut_table(left.join(nodes, "node").select("node", "row"))))
    levels = setjoin.rarity_levels(sets.select(F.explode_outer("shingles").alias("h")), "h")
    described = setjoin.described(F.col("t"), percent)
    rows = setjoin.tokens(sets.withColumnRenamed("node", "id"), F.col("shingles"), levels, "t").select("id", *[v.alias(k) for k, v in described.items()])
    pairs, hot = setjoin.join(cut_table(rows.join(left.withColumnRenamed("node", "id"), "id")), percent, "label", once=True)
    if hot is not None:
        pairs = cut_table(pairs.unionByName(setjoin.self_join(hot, percent, setjoin.levels_of(percent), "label")).distinct())
    return cut_table(verified(plausible(dealt(pairs), nodes, percent), sets, percent))


def labelled_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, row, n_shingles, component_id (the least id of the row's component) and first (the row that stands for it) for every row."""
    own = cut_table(sketches(docs))
    nodes = cut_table(own.filter("n_shingles > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")))
    groups = dealt(cut_table(star_pairs(own.select(F.explode("keys").alias("key"), "node").distinct())))
    pairs = groups.filter("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = linked(docs, pairs, nodes, percent)
    labels = dealt(cut_table(components(links)))
    left = dealt(cut_table(still_open(groups, labels)))
    if not left.isEmpty():
        more = missed_links(docs, left, nodes, percent)
        if not more.isEmpty():
            labels = dealt(cut_table(components(links.unionByName(more))))
    # the least row of a node before those of a component: copies are folded first
    firsts = own.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(_order()).alias("first"))
    known = dealt(cut_table(firsts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))))
    least = known.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("first"))
    of_node = cut_table(known.select("node", "label").join(least, "label").select("node", "component_id", F.col("first.row").alias("first")))
    out = own.select("doc_id", "row", "node", "n_shingles").join(by_size(of_node, 48), "node", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "row", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("row")).otherwise(F.col("first")).alias("first"))


def _order() -> Column:
    """Rows with an id come first, in its order."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")


def find_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    found = labelled_rows(docs, percent)
    return found.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def stage(docs: DataFrame, one_blank: bool = False) -> DataFrame:
    """One row of each component, in the columns that docs has: the first by id, of repeated rows any one.

    Documents without words are linked with nothing and stay. With one_blank they are copies of each other, as after a step that took all words
    of some: the first of them stays.
    """

    def one_each(own: DataFrame) -> DataFrame:
        with scratch(own.sparkSession) as keep:
            rows = keep(labelled_rows(own))
        first = F.col("first")
        if one_blank:
            blank = rows.filter("n_shingles = 0").agg(F.min(_order()).alias("x")).select("x.row").first()["row"]
            first = F.when(F.col("n_shingles") > 0, first).otherwise(F.lit(blank))
        found = rows.withColumn("stays", F.coalesce(F.col("row") == first, F.lit(False)))
        gone = found.filter(~F.col("stays")).select(F.col("row").alias("__row")).distinct()
        twice = cut_table(found.filter(F.col("stays") & ((F.col("n_shingles") > 0) | F.lit(one_blank))).groupBy(F.col("row").alias("__row")).count().filter("count > 1").select("__row"))
        left = own.withColumn("__row", row_key()).join(by_size(gone, 16), "__row", "left_anti")
        if not twice.isEmpty():
            repeated = left.join(by_size(twice, 16), "__row", "left_semi").dropDuplicates(["__row"])
            left = left.join(by_size(twice, 16), "__row", "left_anti").unionByName(repeated)
        return left.drop("__row")

    return shielded(docs, ("doc_id", "text"), one_each)


def expected_miss(percent: int = PERCENT) -> float:
    return math.pow(1 - (percent / 100) ** ROWS, BANDS)
