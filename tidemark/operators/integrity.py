"""The integrity audit: named checks over the ledger's tables, each a join or a window, combined into one frame of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import digest

COLUMNS = ("issue", "record_id", "class", "revision_id", "batch_id", "detail")


def _issues(df: DataFrame, issue: str, detail: str = "") -> DataFrame:
    have = set(df.columns)
    return df.select(
        F.lit(issue).alias("issue"),
        *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in COLUMNS[1:5]],
        F.lit(detail).alias("detail"),
    )


def checks(revisions: DataFrame, observations: DataFrame, batches: DataFrame, heads: DataFrame | None, schemas: DataFrame, identifiers: DataFrame, origins: DataFrame, content: list[str]) -> dict[str, DataFrame]:
    """A frame of issues for each check; heads, identifiers and origins are caches that the ledger must agree with.

    Where heads are derived from the revisions, as in a store, there is nothing to check in them: heads is None.
    """
    key = ["class", "record_id"]
    order = W.partitionBy(*key).orderBy("revision_number")
    committed = batches.filter(F.col("status") == "committed")
    b = committed.select("batch_id", F.col("commit_order").alias("b_order"), F.col("schema_digest").alias("b_schema"))
    r, h, o = revisions.alias("r"), (revisions.limit(0) if heads is None else heads).alias("h"), observations.alias("o")
    head_rows = h.join(r, F.col("h.revision_id") == F.col("r.revision_id")).select("h.class", "h.record_id", "h.revision_id", F.col("h.revision_number").alias("hn"), F.col("r.class").alias("rc"), F.col("r.record_id").alias("ri"), F.col("r.revision_number").alias("rn"), "r.batch_id")
    newest = revisions.groupBy(*key).agg(F.max("revision_number").alias("last"))
    in_batch = revisions.join(b, "batch_id")
    chain = revisions.withColumn("before", F.lag("revision_id").over(order)).withColumn("n_before", F.lag("revision_number").over(order))
    seen = o.join(r, F.col("o.revision_id") == F.col("r.revision_id")).select("o.class", "o.record_id", "o.revision_id", "o.batch_id", "o.disposition", F.col("r.class").alias("rc"), F.col("r.record_id").alias("ri"), F.col("r.operation").alias("op"), F.col("r.batch_id").alias("rb"))
    fits = F.when(F.col("rb") == F.col("batch_id"), F.col("disposition") == F.col("op")).otherwise(F.col("disposition") == "match")
    records = revisions.select(*key).distinct()
    payload = digest(*[F.col(c) for c in content])
    of_heads = {} if heads is None else {
        "orphan_head_revision": _issues(heads.join(revisions.select("revision_id"), "revision_id", "left_anti"), "orphan_head_revision"),
        "head_identity_mismatch": _issues(head_rows.filter("class <> rc or record_id <> ri"), "head_identity_mismatch"),
        "head_revision_number_mismatch": _issues(head_rows.filter("hn <> rn"), "head_revision_number_mismatch"),
        "head_not_latest": _issues(heads.join(newest, key).filter("revision_number < last"), "head_not_latest"),
        "latest_revision_head_mismatch": _issues(newest.join(heads.select(*key, "revision_number"), key, "left").filter("revision_number is null or revision_number <> last"), "latest_revision_head_mismatch"),
    }
    return of_heads | {
        "orphan_revision_batch": _issues(revisions.join(committed.select("batch_id"), "batch_id", "left_anti"), "orphan_revision_batch"),
        "revision_commit_order_mismatch": _issues(in_batch.filter("commit_order <> b_order"), "revision_commit_order_mismatch"),
        "revision_batch_schema_mismatch": _issues(in_batch.filter("schema_digest <> b_schema"), "revision_batch_schema_mismatch"),
        "revision_operation_mismatch": _issues(revisions.filter("(revision_number = 1) <> (operation = 'insert')"), "revision_operation_mismatch"),
        "orphan_revision_schema": _issues(revisions.join(schemas.select("schema_digest"), "schema_digest", "left_anti"), "orphan_revision_schema"),
        "orphan_prior_revision": _issues(revisions.filter("prior_revision_id is not null").join(revisions.select(F.col("revision_id").alias("prior_revision_id")), "prior_revision_id", "left_anti"), "orphan_prior_revision"),
        "revision_chain_mismatch": _issues(chain.filter("not (prior_revision_id <=> before) or revision_number <> coalesce(n_before, 0) + 1"), "revision_chain_mismatch"),
        "orphan_observation_batch": _issues(observations.join(committed.select("batch_id"), "batch_id", "left_anti"), "orphan_observation_batch"),
        "orphan_observation_revision": _issues(observations.join(revisions.select("revision_id"), "revision_id", "left_anti"), "orphan_observation_revision"),
        "observation_identity_mismatch": _issues(seen.filter("class <> rc or record_id <> ri"), "observation_identity_mismatch"),
        "observation_disposition_mismatch": _issues(seen.filter(~fits), "observation_disposition_mismatch"),
        "revision_without_observation": _issues(revisions.join(observations.select(*key, "batch_id", "revision_id"), [*key, "batch_id", "revision_id"], "left_anti"), "revision_without_observation"),
        "duplicate_record_identity": _issues(revisions.groupBy("record_id").agg(F.count_distinct("class").alias("n"), F.min("class").alias("class")).filter("n > 1"), "duplicate_record_identity"),
        "missing_identifier_record": _issues(identifiers.join(records, key, "left_anti"), "missing_identifier_record"),
        "missing_origin_record": _issues(origins.join(records, key, "left_anti"), "missing_origin_record"),
        "revision_digest_mismatch": _issues(revisions.filter(payload != F.col("content_digest")), "revision_digest_mismatch"),
    }


def audit(*args, **kwargs) -> DataFrame:
    """All issues of all checks."""
    return reduce(DataFrame.unionByName, checks(*args, **kwargs).values())


def unsafe_numbers(payload: Column) -> Column:
    """Whether JSON text has a number outside its strings that no reader keeps: a whole one beyond 2^53 - 1, one that is infinite or becomes zero as a double."""
    outside = F.regexp_replace(payload, r'"(?:[^"\\]|\\.)*+"', '""')
    tokens = F.regexp_extract_all(outside, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"), F.lit(1))
    whole = lambda t: t.rlike("^-?[0-9]+$")
    digits = lambda t: F.regexp_replace(t, "^-?0*", "")
    large = lambda t: whole(t) & ((F.length(digits(t)) > 16) | ((F.length(digits(t)) == 16) & (digits(t) > F.lit(str(2**53 - 1)))))
    value = lambda t: t.try_cast("double")
    lost = lambda t: (value(t) == 0) & F.regexp_replace(t, "[eE].*$", "").rlike("[1-9]")
    return F.exists(tokens, lambda t: large(t) | F.coalesce(F.abs(value(t)) == float("inf"), F.lit(True)) | lost(t))


def payload_issues(revisions: DataFrame, schema) -> DataFrame:
    """Revisions whose JSON payload doesn't parse, holds a number that its reader would change, or isn't the text that encoding its values again gives."""
    parsed = F.from_json("payload", schema, {"mode": "PERMISSIVE"})
    valid = F.get_json_object("payload", "$").isNotNull()
    again = F.to_json(parsed, {"ignoreNullFields": "false"})
    rule = F.when(~valid, "invalid_revision_payload").when(unsafe_numbers(F.col("payload")), "unsafe_payload_number").when(again != F.col("payload"), "noncanonical_revision_payload")
    found = revisions.withColumn("issue", rule).filter("issue is not null")
    return found.select("issue", *[F.col(c).cast("string") for c in COLUMNS[1:5]], F.lit("").alias("detail"))
