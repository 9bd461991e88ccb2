"""Sharding by a keyed permutation of global row numbers, in DataFrame functions only.

Rows get gapless global numbers that depend on the rows alone: equal rows are counted, distinct rows are dealt to
`buckets` by their hash and numbered there, and each bucket starts where the ones before it end. A Feistel network over
the mixed radix domain a * b >= n permutes the numbers; numbers that leave [0, n) walk on along their cycle. With position
p, the shard is p mod shards and the slot p div shards, so counts differ by one at most and both can be computed from the
row number, the seed and n alone.

Defined results: repeated rows (equal in all columns) get numbers and slots of their own; null values are values like any
other; an empty table gives an empty result; other columns stay, and input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of, without

ADDED = ("row_number", "position", "shard", "slot")
#: Buckets in which distinct rows are numbered; the table of their sizes is the only thing broadcast.
BUCKETS = 4096
ROUNDS = 6
#: Steps along a cycle that are tried at once before the proven bound is used.
SHORT_WALK = 16


def number_rows(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """df with row_number, gapless from 0, and n_rows. Distinct rows are spread by hash, copies of a row are counted first."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    counted = (
        df.groupBy(*cols)
        .agg(F.count("*").alias("__copies"))
        .withColumn("__hash", F.xxhash64(*cols, F.lit(0)))
        .withColumn("__bucket", F.coalesce(F.pmod("__hash", F.lit(buckets)), F.lit(0)))  # never null: no filter that would keep the two uses of the counts apart
    )
    all_before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    sizes = counted.groupBy("__bucket").agg(F.sum("__copies").alias("__size"))
    starts = sizes.select(
        "__bucket",
        F.coalesce(F.sum("__size").over(all_before), F.lit(0)).alias("__start"),
        F.sum("__size").over(everything).alias("n_rows"),
    )
    in_bucket = W.partitionBy("__bucket").orderBy("__hash", *[c.asc_nulls_first() for c in cols])
    return (
        counted.withColumn("__before", F.sum("__copies").over(in_bucket.rowsBetween(W.unboundedPreceding, 0)) - F.col("__copies"))
        .join(F.broadcast(starts), "__bucket")  # at most `buckets` rows of three numbers
        .withColumn("__first", F.col("__start") + F.col("__before"))
        .select(*cols, "n_rows", F.explode(F.sequence("__first", F.col("__first") + F.col("__copies") - 1)).alias("row_number"))
    )


def _round(k: int, seed: int, left: Column, right: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """One Feistel round on (left mod a, right mod b): the halves are changed in turn, each by a keyed hash of the other."""
    if k % 2 == 0:
        return F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), right), a), a), right
    return left, F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), left), b), b)


def _permute_once(x: Column, a: Column, b: Column, seed: int) -> Column:
    """The network on one number, as an expression for use inside higher-order functions."""
    start = F.struct((x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))

    def step(s: Column, k: Column) -> Column:
        left, right, even = s["l"], s["r"], F.pmod(k, F.lit(2)) == 0
        new_left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), k, right), a), a)
        new_right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), k, left), b), b)
        return F.struct(F.when(even, new_left).otherwise(left).alias("l"), F.when(even, right).otherwise(new_right).alias("r"))

    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, step, lambda s: s["l"] * b + s["r"])


def permute(df: DataFrame, seed: int) -> DataFrame:
    """df with position: the permuted row_number in [0, n_rows).

    The domain a * b exceeds n by at most 2 * sqrt(n) + 1 numbers and a walk meets none of them twice, so a walk of that
    length always ends inside; few rows walk at all, and nearly all of those end within SHORT_WALK steps.
    """
    n, a, b = F.col("n_rows"), F.col("__a"), F.col("__b")
    df = df.withColumn("__a", F.ceil(F.sqrt(n.cast("double"))).cast("long") + 1)
    df = df.withColumn("__b", F.ceil((n + a - 1) / a).cast("long"))
    df = df.withColumn("__l", F.floor(F.col("row_number") / b).cast("long")).withColumn("__r", F.pmod("row_number", b))
    for k in range(ROUNDS):
        left, right = _round(k, seed, F.col("__l"), F.col("__r"), a, b)
        df = df.withColumn("__l" if k % 2 == 0 else "__r", left if k % 2 == 0 else right)
    df = df.withColumn("__p", F.col("__l") * b + F.col("__r"))

    def walk(x: Column, steps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), x, lambda p, _: F.when(p < n, p).otherwise(_permute_once(p, a, b, seed)))

    p = F.col("__p")
    df = df.withColumn("__p", F.when(p < n, p).otherwise(walk(p, F.lit(SHORT_WALK).cast("long"))))
    df = df.withColumn("position", F.when(p < n, p).otherwise(walk(p, a * b - n + 1)))
    return df.drop("__a", "__b", "__l", "__r", "__p")


def shard_rows(df: DataFrame, shards: int, seed: int = 2024, buckets: int = BUCKETS) -> DataFrame:
    """df with row_number, position, shard in [0, shards) and slot, gapless from 0 in each shard."""
    numbered = number_rows(without(df, *ADDED, "n_rows"), buckets)
    return (
        permute(numbered, seed)
        .withColumn("shard", F.pmod("position", F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("position") / shards).cast("long"))
        .drop("n_rows")
    )


def shard_documents(docs: DataFrame, shards: int, seed: int = 2024) -> DataFrame:
    """docs, texts included, with their shards and slots: each row is moved once, with what it holds."""
    return shard_rows(docs, shards, seed)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 24, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard of each document from its id, size and CRC-32; texts themselves aren't moved."""
    text = text_of(f"`{text_col}`")
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_rows(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position"
    )


__all__ = ["digest", "number_rows", "permute", "shard_documents", "shard_rows", "write_shards"]
