"""Reads over the revision ledger: heads, as-of states, history, change detection, snapshots. All are frames to frames.

A ledger has, for each revision: class, record_id, revision_number, revision_id, batch_id, commit_order, operation,
content_digest, prior_revision_id and content columns. Heads are derived, never stored: the latest revision of a record is a
window over its own rows, which Spark cuts to one row for each record before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import digest

KEY = ("class", "record_id")


def latest(revisions: DataFrame) -> DataFrame:
    """The latest revision of each record that isn't a deletion."""
    order = W.partitionBy(*KEY).orderBy(F.desc("commit_order"), F.desc("revision_number"), F.asc("revision_id"))
    ranked = revisions.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1")
    return ranked.drop("__rank").filter(F.col("operation") != "delete")


def as_of(revisions: DataFrame, commit_order: int) -> DataFrame:
    """The state at a boundary: the latest revisions among those committed up to it."""
    return latest(revisions.filter(F.col("commit_order") <= commit_order))


def boundary_at(batches: DataFrame, when: Column) -> DataFrame:
    """One row: the greatest commit order committed at or before a time, 0 if there is none."""
    return batches.filter(F.col("committed_at") <= when).agg(F.coalesce(F.max("commit_order"), F.lit(0)).alias("commit_order"))


def history(revisions: DataFrame, record_id: str | None = None, up_to: int | None = None) -> DataFrame:
    """Revisions, newest first; of one record or of all, up to a boundary."""
    out = revisions if record_id is None else revisions.filter(F.col("record_id") == record_id)
    out = out if up_to is None else out.filter(F.col("commit_order") <= up_to)
    return out.orderBy(F.desc("commit_order"), F.asc("class"), F.asc("record_id"), F.desc("revision_number"), F.asc("revision_id"))


def snapshot(batches: DataFrame) -> DataFrame:
    """One row: the latest boundary."""
    return batches.agg(F.max("commit_order").alias("commit_order"), F.max_by("batch_id", "commit_order").alias("batch_id"), F.max_by("committed_at", "commit_order").alias("committed_at"))


def observe(states: DataFrame, content: list[str]) -> DataFrame:
    """Dispositions of a series of states (class, record_id, commit_order, content): insert, update or match by digest."""
    own = W.partitionBy(*KEY).orderBy("commit_order")
    out = states.withColumn("content_digest", digest(*[F.col(c) for c in content]))
    out = out.withColumn("prior_digest", F.lag("content_digest").over(own))
    return out.withColumn(
        "disposition", F.when(F.col("prior_digest").isNull(), "insert").when(F.col("prior_digest") == F.col("content_digest"), "match").otherwise("update")
    )


def revisions_of(observations: DataFrame) -> DataFrame:
    """The revisions that observations made: matches point to an existing one and make none."""
    own = W.partitionBy(*KEY).orderBy("commit_order")
    made = observations.filter(F.col("disposition") != "match").withColumn("revision_number", F.row_number().over(own))
    made = made.withColumn("revision_id", F.concat_ws("#", "record_id", "revision_number"))
    made = made.withColumn("prior_revision_id", F.lag("revision_id").over(own))
    return made.withColumnRenamed("disposition", "operation").drop("prior_digest")


def changed_fields(revisions: DataFrame, content: list[str]) -> DataFrame:
    """revisions with the sorted names of content fields that differ from the prior revision; all of them on an insert."""
    own = W.partitionBy(*KEY).orderBy("revision_number")
    first = F.lag("revision_number").over(own).isNull()
    parts = [F.when(first | ~F.col(c).eqNullSafe(F.lag(c).over(own)), F.lit(c)) for c in sorted(content)]
    return revisions.withColumn("changed_fields", F.concat_ws(",", *parts))


def action_counts(observations: DataFrame) -> DataFrame:
    """inserted, updated and matched records of each batch."""
    count = lambda d: F.count_if(F.col("disposition") == d)
    return observations.groupBy("commit_order").agg(count("insert").alias("inserted"), count("update").alias("updated"), count("match").alias("matched"))


def bounded(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows in a total order, and one row that tells whether more were there."""
    probe = df.orderBy(*order).limit(limit + 1)
    return probe.orderBy(*order).limit(limit), probe.agg((F.count("*") > limit).alias("truncated"))


def page_after(df: DataFrame, keys: list[str], after: tuple, size: int) -> DataFrame:
    """The next rows in key order after a cursor."""
    return df.filter(F.struct(*keys) > F.struct(*[F.lit(v) for v in after])).orderBy(*keys).limit(size)
