"""Mixing of overlapping sources to target weights: min-cost flow over membership patterns, then seeded documents.

Documents may belong to several sources at once. Documents with the same set of sources form a pattern; patterns are few,
and only their summed sizes go into the flow network: start -> pattern, in `passes` parallel arcs of the pattern's size
whose costs rise (each further repetition costs more, so the total cost is convex); pattern -> each of its sources; source
-> end, as wide as the source's quota. The cheapest maximum flow (shortest paths with potentials, blocking flows) repeats as little
as the quotas allow. The flow of a pattern is then laid over its documents, in the order of a keyed hash: they stand end to
end, once for each pass, and every source takes one stretch. Where a document begins is a running sum within buckets of the
hash, about sqrt(rows) of them, so no task holds a pattern and the driver sees sums alone.

Targets: the sources share the wanted words by weight; a target stops at `passes` times its source's size, and the excess is
shared again by weight until none is above. Quotas are targets rounded down to whole words, so that a source lies less than one
word below its target, unless its documents are needed elsewhere; the last document of a stretch may be taken in part.

Defined results: null text has size 0; a null source (or an empty or null list of sources) is a source of its own, last in
order; repeated rows are documents of their own, alike ones are interchangeable; ties of the hash go by id (null ids
first), size and a hash of the text; empty tables give empty results; only the named columns are read, so no other column can clash. A source
without words has target 0. More than `PATTERNS` patterns are refused with an error before anything is mixed.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, by_size, cut_table, text_of

#: Times that a document may be taken.
PASSES = 3
#: Patterns of sources that the driver solves for; each is a few numbers.
PATTERNS = 100_000
SEED = 2024


class Network:
    """A flow network of integer capacities and costs; `flow` of an arc is the capacity of its reverse."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def cheapest(self, start: int, end: int) -> tuple[int, int]:
        """The largest flow from start to end at the least cost; its size and cost. All costs given are at least 0."""
        potential, size, total = [0] * len(self.out), 0, 0
        while True:
            far = self._distances(start, potential)
            if far[end] is None:
                return size, total
            most = max(d for d in far if d is not None)
            potential = [p + (most if d is None else d) for p, d in zip(potential, far, strict=True)]
            moved = self._block(start, end, potential)
            size += moved
            total += moved * (potential[end] - potential[start])

    def _distances(self, start: int, potential: list[int]) -> list[int | None]:
        far: list[int | None] = [None] * len(self.out)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in self.out[a]:
                b = self.to[e]
                new = d + self.cost[e] + potential[a] - potential[b]
                if self.room[e] and (far[b] is None or new < far[b]):
                    far[b] = new
                    heapq.heappush(heap, (new, b))
        return far

    def _block(self, start: int, end: int, potential: list[int]) -> int:
        """As much as goes along arcs without reduced cost: rounds of breadth-first levels and depth-first paths."""
        moved = 0
        tight = lambda a, e: self.room[e] and self.cost[e] + potential[a] == potential[self.to[e]]
        while True:
            level, queue = {start: 0}, [start]
            for a in queue:
                for e in self.out[a]:
                    if tight(a, e) and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if end not in level:
                return moved
            at, path, a = {x: 0 for x in level}, [], start
            while True:
                if a == end:
                    least = min(self.room[e] for e in path)
                    moved += least
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    a, path = start, []
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if tight(a, e) and level.get(self.to[e]) == level[a] + 1:
                        break
                    at[a] += 1
                else:
                    if a == start:
                        break
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = self.to[e]


def share(sizes: list[int], weights: list[int], wanted: int, passes: int = PASSES) -> list[Fraction]:
    """Targets by weight that stop at `passes` times the size, the excess shared again; exact."""
    targets, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(wanted)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] > passes * sizes[i] * whole}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in full:
            targets[i] = Fraction(passes * sizes[i])
            left -= targets[i]
        open_ -= full
    return targets


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], passes: int = PASSES) -> list[list[int]]:
    """What each pattern, given by its sources' numbers and its size, sends to each of its sources."""
    start, end, first = 0, 1, 2 + len(quotas)
    net = Network(first + len(patterns))
    for i, quota in enumerate(quotas):
        net.arc(2 + i, end, quota)
    sent = []
    for k, (members, size) in enumerate(patterns):
        for again in range(passes):
            net.arc(start, first + k, size, again * again)  # 0, 1, 4: convex
        sent.append([net.arc(first + k, 2 + i, passes * size) for i in members])
    net.cheapest(start, end)
    return [[net.flow(e) for e in arcs] for arcs in sent]


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


@dataclass(frozen=True)
class Plan:
    """sources: source (null: none), source_size, weight, target, quota, taken. stretches: pattern, source_number, from, to."""

    sources: DataFrame
    stretches: DataFrame


@dataclass(frozen=True)
class Mix:
    """documents: doc_id, sources, size, text_hash, n_taken, parts (source, words) for each row of the input; plan: what was asked and sent."""

    documents: DataFrame
    plan: Plan


def mix(
    docs: DataFrame,
    sources: Column,
    weights: dict[str | None, int] | None = None,
    wanted: int | None = None,
    passes: int = PASSES,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Mix:
    """Mixes docs to targets by weight. sources: each document's array of names. weights: of each name; those without one, and all
    where none are given, weigh 1, 2, 3, repeating, in the order of code points. wanted: words of the mix; else those of all documents."""
    spark = docs.sparkSession
    member = F.when(F.size(F.coalesce(sources, F.array())) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), member.cast("array<string>").alias("sources"), word_count(text_of(f"`{text_col}`")).alias("size"), F.xxhash64(text_of(f"`{text_col}`")).alias("text_hash"))
    # rows that are alike are counted, so that no id gathers them in one bucket
    alike = cut_table(narrow.groupBy("doc_id", "sources", "size", "text_hash").agg(F.count("*").alias("copies")))

    found = alike.groupBy("sources").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("rows")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns of sources")
    found.sort(key=lambda r: [(s is None, s or "") for s in r["sources"]])
    names = sorted({s for r in found for s in r["sources"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r["sources"]:
            sizes[number[s]] += r["words"]
    cycle = [1 + i % 3 for i in range(len(names))]
    weight = [cycle[i] if weights is None else weights.get(s, cycle[i]) for i, s in enumerate(names)]
    targets = share(sizes, weight, sum(r["words"] for r in found) if wanted is None else wanted, passes)
    quotas = [int(t) for t in targets]
    sent = route([(tuple(number[s] for s in r["sources"]), r["words"]) for r in found], quotas, passes)

    got, stretches, patterns = [0] * len(names), [], []
    for k, (r, flows) in enumerate(zip(found, sent, strict=True)):
        at, own = 0, []
        for s, f in zip(r["sources"], flows, strict=True):
            got[number[s]] += f
            own.append((s, at, at + f))
            stretches.append((k, s, at, at + f))
            at += f
        buckets = max(0, (max(1, r["rows"]) - 1).bit_length() // 2)
        patterns.append((k, r["sources"], r["words"], at, buckets, own))
    source_rows = [(s, sizes[i], weight[i], float(targets[i]), quotas[i], got[i]) for i, s in enumerate(names)]
    plan = Plan(
        spark.createDataFrame(source_rows, "source string, source_size long, weight int, target double, quota long, taken long"),
        spark.createDataFrame(stretches, "pattern int, source string, `from` long, `to` long"),
    )
    kind = T._parse_datatype_string("__pattern int, __sources array<string>, __words long, __taken long, __bits int, __own array<struct<source:string,from:long,to:long>>")
    table = by_size(spark.createDataFrame(patterns, kind), 400)

    # the same order from any engine: the first 60 bits of a digest of seed and id
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = alike.join(table, F.col("sources") == F.col("__sources"))  # arrays with null members are equal to each other
    rows = rows.withColumn("__key", key).withColumn("__bucket", F.expr("shiftright(__key, 60 - __bits)"))
    weighty = F.col("size") * F.col("copies")
    sums = rows.groupBy("__pattern", "__bucket").agg(F.sum(weighty).alias("__sum"))
    starts = sums.select("__pattern", "__bucket", (F.sum("__sum").over(W.partitionBy("__pattern").orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("__sum")).alias("__start"))
    in_bucket = W.partitionBy("__pattern", "__bucket").orderBy("__key", F.col("doc_id").asc_nulls_first(), "size", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("__before", F.sum(weighty).over(in_bucket) - weighty).join(starts, ["__pattern", "__bucket"])
    each = placed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("__at", F.col("__start") + F.col("__before") + (F.col("__copy") - 1) * F.col("size"))

    def words(low: Column, high: Column) -> Column:
        """Of the document, in any pass, from low up to high in its pattern's line."""
        parts = [F.greatest(F.lit(0), F.least(high, F.col("__at") + j * F.col("__words") + F.col("size")) - F.greatest(low, F.col("__at") + j * F.col("__words"))) for j in range(passes)]
        return sum(parts[1:], parts[0])

    parts = F.transform("__own", lambda o: F.struct(o["source"].alias("source"), words(o["from"], o["to"]).alias("words")))
    mixed = each.select("doc_id", "sources", "size", "text_hash", words(F.lit(0).cast("long"), F.col("__taken")).cast("long").alias("n_taken"), F.filter(parts, lambda p: p["words"] > 0).alias("parts"))
    return Mix(mixed, plan)


def digest(docs: DataFrame) -> DataFrame:
    """Each document's size, what its one source has and should give, and the words taken of it."""
    mixed = mix(docs, F.array(F.col("source").cast("string")))
    sources = by_size(mixed.plan.sources.select("source", "source_size", "target"), 200)
    rows = mixed.documents.withColumn("source", F.get("sources", F.lit(0)))
    return rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "source_size", "target", F.col("n_taken").alias("taken"), rows["source"], F.floor(F.try_divide("n_taken", "size")).cast("long").alias("repeats"))


def materialize(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts of the mix, a row for each repetition: doc_id, repetition, text; of a document taken in part its first words.

    Rows that are alike in id and text are taken as often as the mix says for them together.
    """
    text = text_of(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).dropDuplicates()
    takes = mixed.documents.filter("n_taken > 0").groupBy("doc_id", "text_hash", "size", "n_taken").agg(F.count("*").alias("rows"))
    rows = texts.join(takes, texts["doc_id"].eqNullSafe(takes["doc_id"]) & (texts["text_hash"] == takes["text_hash"])).drop(takes["doc_id"], takes["text_hash"])
    whole = F.ceil(F.col("n_taken") / F.col("size"))
    each = rows.select("doc_id", "text", "size", "n_taken", F.explode(F.sequence(F.lit(1).cast("long"), "rows")), whole.alias("n")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("repetition"))
    rest = F.least(F.col("size"), F.col("n_taken") - (F.col("repetition") - 1) * F.col("size")).cast("int")
    part = F.concat_ws(" ", F.slice(F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != ""), F.lit(1), rest))
    return each.select("doc_id", "repetition", F.when(rest == F.col("size"), F.col("text")).otherwise(part).alias("text"))
