"""Exact set-similarity join in DataFrame functions: rarity order, prefix, length and positional filters.

A token is a long whose high byte is the rarity level of its hash bin and whose low 56 bits are the token's hash, so the
natural order of a sorted array of tokens is the rarity order. Bins are counted over all rows; their number is fixed, so
the levels are a small constant.

Two sets that reach the threshold share a token of their prefixes. A token that stands in the prefixes of more than HOT sets
isn't joined by itself: there the second token that both share is in their prefixes longer by one, so pairs of tokens are the
keys, and where such a pair is still hot, triples. So the join does work in proportion to its rows, up to keys that are hot as triples,
and no pair is missed. Besides, each set carries the parity of its tokens' hashes in 64 or 128 cells: the cells in which two sets
differ are never more than the tokens in which they do, so most unlike pairs end inside the join. Fine parities have up to 256 cells, more of
them for each token, so that hardly an unlike pair passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, cut_table

#: Bins of the rarity count: 2 ** BIN_BITS levels are all that reaches the driver.
BIN_BITS = 16
BINS = 1 << BIN_BITS
_HASH = (1 << 56) - 1
#: A key in more sets' prefixes than so many is lengthened by a token.
HOT = 4096
#: Tokens of the longest key.
LEVELS = 3
#: Sets of more tokens have their parities in two words.
WIDE = 64
#: Columns of a set that its keys carry.
OWN = ("id", "n", "pos", "low", "high")
#: Further columns of fine parities, and sizes above which these have two words and four.
FINE = ("low2", "high2")
FINE_WIDE, FINE_WIDEST = 32, 128
#: The tokens before a key's, the nearest first and two to a number, where rows carry them.
BEFORE = ("before0", "before1")


def bin_of(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BIN_BITS).cast("int")


def level_of(count: int) -> int:
    return min(127, math.floor(4 * math.log2(count + 1) + 1e-9))


def rarity_levels(hashes: DataFrame, col: str) -> Column:
    """A constant array: the level of each bin, 4 to each doubling of its count over all rows of hashes."""
    counts = hashes.filter(F.col(col).isNotNull()).groupBy(bin_of(F.col(col)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = {r["bin"]: level_of(r["n"]) for r in counts.collect()}  # BINS rows at most
    # folded into one constant when the plan is optimized
    return F.split(F.lit(",".join(str(found.get(b, 0)) for b in range(BINS))), ",").cast("array<tinyint>")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, also where f uses it inside a lambda function."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(df: DataFrame, hashes: Column, levels: Column, name: str) -> DataFrame:
    """df with a column of the sorted distinct tokens of an array of 64-bit hashes."""
    level = lambda h: F.shiftleft(F.get(levels, bin_of(h)).cast("long"), 56)
    made = F.transform(hashes, lambda h: level(h).bitwiseOR(h.bitwiseAND(F.lit(_HASH))))
    # the explosion of one element parts the lambda functions, which are interpreted, from sorting, which is compiled
    return df.withColumn(name, F.explode(F.array(made))).withColumn(name, F.sort_array(F.array_distinct(name)))


def prefix_length(n: Column, percent: int) -> Column:
    """Two sets of n tokens and Jaccard of at least percent / 100 share one of so many first tokens."""
    return (n - F.ceil(n * percent / F.lit(100.0)) + 1).cast("int")


def levels_of(percent: int) -> int:
    """How many tokens a key may have: unlike sets that reach the threshold share so many at least."""
    return max(1, min(LEVELS, math.ceil(percent / (100 - percent)))) if percent < 100 else LEVELS


def described(t: Column, percent: int, fine: bool = False) -> dict[str, Column]:
    """What the join needs of a set of tokens: its size, the hashes and levels of its longest prefix, and its parities, with fine those with FINE."""
    n = F.size(t)

    cell = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    none = F.lit(0).cast("long")

    def parity(part: int, bits: int = 64) -> Column:
        return F.aggregate(t, none, lambda a, x: F.when(x.bitwiseAND(F.lit(bits)) == 64 * part, a.bitwiseXOR(cell(x))).otherwise(a))

    whole = F.aggregate(t, none, lambda a, x: a.bitwiseXOR(cell(x)))
    parities = {"low": F.when(n > WIDE, parity(0)).otherwise(whole), "high": F.when(n > WIDE, parity(1)).otherwise(none)}
    if fine:
        names = ("low", "high", *FINE)
        parities = {c: F.when(n > FINE_WIDEST, parity(i, 192)).when(n > FINE_WIDE, parity(i) if i < 2 else none).otherwise(none if i else whole) for i, c in enumerate(names)}
    first = F.slice(t, F.lit(1), prefix_length(n, percent) + (levels_of(percent) - 1))
    return {
        "n": n,
        "prefix": F.transform(first, lambda x: F.hash(x)),
        "levels": F.transform(first, lambda x: F.shiftright(x, 56).cast("tinyint")),
        **parities,
    }


def may_match(a: Callable[[str], Column], b: Callable[[str], Column], percent: int, shared: int | Column = 1, fine: bool = False) -> Column:
    """Length, positional and parity filters for two sets at a key whose last token, the shared-th of it, is at pos."""
    both, least = a("n") + b("n"), F.least(a("n"), b("n"))
    lengths = 100 * least >= percent * F.greatest(a("n"), b("n"))
    places = (100 + percent) * (F.least(a("n") - a("pos"), b("n") - b("pos")) + (shared - 1)) >= percent * both
    wide = F.bit_count(a("low").bitwiseXOR(b("low"))) + F.bit_count(a("high").bitwiseXOR(b("high")))
    fold = lambda x: x("low").bitwiseXOR(x("high"))
    differ = F.when(least > WIDE, wide).otherwise(F.bit_count(fold(a).bitwiseXOR(fold(b))))
    if fine:
        apart = [a(c).bitwiseXOR(b(c)) for c in ("low", "high", *FINE)]
        halves = [apart[i].bitwiseXOR(apart[i + 2]) for i in (0, 1)]
        count = lambda words: reduce(Column.__add__, map(F.bit_count, words))
        differ = F.when(least > FINE_WIDEST, count(apart)).when(least > FINE_WIDE, count(halves)).otherwise(F.bit_count(halves[0].bitwiseXOR(halves[1])))
    return lengths & places & ((100 + percent) * differ <= (100 - percent) * both)


def before(prefix: Column, pos: Column) -> dict[str, Column]:
    """BEFORE of the token at pos of a prefix."""
    at = lambda k: F.coalesce(F.get(prefix, pos - k), F.lit(0)).cast("long")
    return {c: F.shiftleft(at(2 * k + 1), 32).bitwiseOR(at(2 * k + 2).bitwiseAND(F.lit(0xFFFFFFFF))) for k, c in enumerate(BEFORE)}


def met_before(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether two sets at a key of one token share one of the tokens that stand just before it: they meet there as well, and with fewer tokens behind them."""

    def at(x: Callable[[str], Column], k: int) -> Column:
        two = x(BEFORE[(k - 1) // 2])
        return F.shiftrightunsigned(two, 32) if k % 2 else two.bitwiseAND(F.lit(0xFFFFFFFF))

    places = range(1, 2 * len(BEFORE) + 1)
    return reduce(Column.__or__, [(a("pos") >= i) & (b("pos") >= j) & (at(a, i) == at(b, j)) for i in places for j in places])


def _side(name: str) -> Callable[[str], Column]:
    return lambda c: F.col(f"{name}.{c}")


def meetings(x: DataFrame, y: DataFrame, percent: int, shared: int, further: Column) -> DataFrame:
    """Pairs (a, b) of the ids of rows x and y for each key at which they meet and pass the filters and a further condition."""
    holds = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & may_match(_side("x"), _side("y"), percent, shared)
    # rows of keys are exploded from a table: Spark would go by the size of that table and broadcast them
    pairs = x.hint("merge").alias("x").join(y.alias("y"), holds & further)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def met(x: DataFrame, y: DataFrame, percent: int, shared: int, further: Column) -> DataFrame:
    """Distinct pairs of meetings."""
    return meetings(x, y, percent, shared, further).distinct()


def self_join(keyed: DataFrame, percent: int, shared: int, group: str | None) -> DataFrame:
    """Distinct pairs (a < b) of ids that meet at a key, pass the filters and, with group, are of different groups."""
    further = F.col("x.id") < F.col("y.id")
    if BEFORE[0] in keyed.columns:
        further = further & ~met_before(_side("x"), _side("y"))
    if group:
        further = further & (F.col(f"x.{group}") != F.col(f"y.{group}"))
    return met(keyed, keyed, percent, shared, further)


def keys(nodes: DataFrame, percent: int, extra: tuple[str, ...] = (), once: bool = False) -> Iterator[tuple[int, DataFrame, bool]]:
    """The rows of keys by the number of their tokens, those of hot keys left out; then those that are hot at every length, where there are any.

    Each with the number of tokens and whether its keys are hot. nodes: a row for each id with the columns of described() and extra ones.
    """
    top = levels_of(percent)
    own = (*(c for c in OWN if c != "pos"), *(c for c in FINE if c in nodes.columns), *extra)
    carried = (*own, "pos")  # in the order in which they come: where a side of a self-join is projected once more, it's another exchange
    rows = nodes.select(*own, "prefix", "levels", F.posexplode(F.slice("prefix", F.lit(1), prefix_length(F.col("n"), percent))).alias("pos", "token"))
    rows = rows.withColumns({"key": F.col("token").cast("long"), "level": F.get("levels", F.col("pos")), **(before(F.col("prefix"), F.col("pos")) if once else {})}).drop("levels", "token")
    for shared in range(1, top + 1):
        # a token in a bin of at most HOT rows isn't hot
        some = rows.filter(F.col("level") >= level_of(HOT + 1)) if shared == 1 else rows
        hot = cut_table(some.groupBy("key").count().filter(F.col("count") > HOT).select("key"))
        none = hot.isEmpty()
        hot = hot if none else by_size(hot, 16)
        keyed = rows.select(*carried, *(BEFORE if once and shared == 1 else ()), "key")
        yield shared, keyed if none else keyed.join(hot, "key", "left_anti"), False
        if none:
            return
        rows = rows.join(hot, "key", "left_semi")
        if shared == top:
            yield shared, rows.select(*carried, "key"), True
            return
        # one token more, from the rest of the prefix that is longer by one
        rest = F.slice("prefix", F.col("pos") + 2, F.greatest(prefix_length(F.col("n"), percent) + shared - 1 - F.col("pos"), F.lit(0)))
        rows = rows.select(*own, "prefix", F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.posexplode(rest).alias("__k", "token"))
        rows = rows.select(*own, "prefix", (F.col("__pos") + 1 + F.col("__k")).alias("pos"), F.xxhash64("__key", "token").alias("key"))


def join(nodes: DataFrame, percent: int, group: str | None = None, once: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a, b), and the rows of keys that are hot at every length, None where there are none.

    nodes: a row for each id with the columns of described() and, if given, group. A pair that reaches the threshold is among the
    candidates or meets at a key of the hot rows. once: pairs that share many tokens don't meet at each of them: rows also carry the
    tokens before theirs, and of shared tokens that stand close to each other only the first makes a pair. The first that two sets share always does.
    """
    found, hot = [], None
    for shared, rows, is_hot in keys(nodes, percent, (group,) if group else (), once):
        if is_hot:
            hot = cut_table(rows)
        else:
            found.append(self_join(rows, percent, shared, group))
    return _all(found), hot


def partnered(rows: DataFrame, percent: int, shared: int) -> DataFrame:
    """The rows that pass the filters with another one at their key. No pairs are made: a group of m rows gives m at most.

    Both sides are the same frame, which is shuffled once.
    """
    holds = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & may_match(_side("x"), _side("y"), percent, shared, FINE[0] in rows.columns)
    return rows.hint("merge").alias("x").join(rows.alias("y"), holds, "left_semi")


def partnered_rows(nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of all keys, with shared (the tokens of their key), that pass the filters with another one there; those of hot keys all."""
    parts = [(rows if hot else partnered(rows, percent, shared)).withColumn("shared", F.lit(shared)) for shared, rows, hot in keys(nodes, percent)]
    return cut_table(reduce(DataFrame.unionByName, parts))


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return cut_table(out if len(found) == 1 else out.distinct())


def similar(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n_a + n_b - shared)
