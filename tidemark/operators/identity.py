"""Identity helpers: groups of candidates that share a key, registries that keep what they know. plans.plan resolves with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def components(keys: DataFrame) -> DataFrame:
    """candidate and component: the least candidate of those linked by shared keys, over any number of steps.

    Each key links its candidates with the least of them; large and small stars alternate until no link changes, in a number
    of rounds that grows with the logarithm of the longest chain. Checkpoints cut the plan.
    """
    keys = cut(keys)

    def star(links: DataFrame, large: bool) -> DataFrame:
        if large:
            sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = sides.join(least, "a").filter("b > a" if large else "true").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (out if large else out.unionByName(least.select("a", F.col("m").alias("b")))).filter("a != b").distinct()

    centers = keys.groupBy("key").agg(F.min("candidate").alias("b"))
    links = cut(keys.join(centers, "key").filter("candidate != b").select(F.col("candidate").alias("a"), "b").distinct())
    while True:
        now = cut(star(star(links, True), False))
        if now.count() == links.count() and now.join(links, ["a", "b"], "left_anti").isEmpty():
            break
        links = now
    labels = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "candidate")
    return keys.select("candidate").distinct().join(labels, "candidate", "left").withColumn("component", F.coalesce("component", "candidate"))


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """New registry rows with unknown keys, and conflicts: known keys that stand for something else."""
    clash = new.join(existing.select(*keys, F.col(value).alias("known")), keys).filter(F.col(value) != F.col("known"))
    return new.join(existing.select(*keys), keys, "left_anti"), clash
