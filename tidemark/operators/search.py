"""Bounded reads over current records: search, identifier lookup, claims, evidence, unresolved mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize_identifier

STATUS = ("primary", "equivalent", "candidate")


def matched_fields(fields: list[str], query: str) -> Column:
    """Names of the fields that contain the query, whatever its case, joined by commas."""
    return F.concat_ws(",", *[F.when(F.contains(F.lower(F.col(f)), F.lit(query.lower())), F.lit(f)) for f in fields])


def find(records: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Records with a field that contains the query as plain text, with the names of these fields."""
    return records.withColumn("matched_fields", matched_fields(fields, query)).filter("matched_fields <> ''")


def status_rank(status: Column) -> Column:
    rank = F.lit(len(STATUS))
    for i, s in reversed(list(enumerate(STATUS))):
        rank = F.when(status == s, F.lit(i)).otherwise(rank)
    return rank


def register(values: DataFrame) -> DataFrame:
    """Identifier rows (class, record_id, namespace, value, first_order) in normal form; a record's first is its primary."""
    own = values.withColumn("normalized", normalize_identifier(F.col("namespace"), F.col("value"))).filter("normalized is not null")
    own = own.groupBy("class", "record_id", "namespace", "normalized").agg(F.min("first_order").alias("first_order"))
    first = W.partitionBy("class", "record_id").orderBy("first_order", "namespace", "normalized")
    return own.withColumn("status", F.when(F.row_number().over(first) == 1, "primary").otherwise("equivalent"))


def lookup(identifiers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records behind wanted (namespace, value) pairs, by normal form; n_records tells ambiguous ones in a class."""
    asked = wanted.withColumn("normalized", normalize_identifier(F.col("namespace"), F.col("value")))
    found = asked.join(identifiers.filter(F.col("status").isin("primary", "equivalent")).select("class", "record_id", "namespace", "normalized", "status"), ["namespace", "normalized"])
    per = found.groupBy("namespace", "normalized", "class").agg(F.count_distinct("record_id").alias("n_records"))
    return found.join(per, ["namespace", "normalized", "class"])


def lookup_classes(identifiers: DataFrame, wanted: DataFrame, order: str = "record_id") -> DataFrame:
    """wanted with the first record behind each identifier and how many there are in a class: many lookups at once, a row for each."""
    asked = wanted.withColumn("normalized", normalize_identifier(F.col("namespace"), F.col("value")))
    per = identifiers.filter(F.col("status").isin("primary", "equivalent")).groupBy("class", "namespace", "normalized")
    known = per.agg(F.min_by("record_id", order).alias("first_record"), F.count_distinct("record_id").alias("n_records"))
    return asked.join(known, ["namespace", "normalized"])


def conflicts(identifiers: DataFrame) -> DataFrame:
    """Identifiers of a class that stand for several records."""
    per = identifiers.groupBy("class", "namespace", "normalized").agg(F.count_distinct("record_id").alias("n_records"), F.min("record_id").alias("first_record"))
    return per.filter("n_records > 1")


def claims(statements: DataFrame, record_id: str | None = None, predicate: str | None = None, superseded: bool = False) -> DataFrame:
    """Statements about a record as subject, object or one of `about`; by default the active ones only."""
    out = statements
    if record_id is not None:
        out = out.filter((F.col("subject") == record_id) | (F.col("object_entity") == record_id) | F.array_contains("about", record_id))
    if predicate is not None:
        out = out.filter(F.col("predicate") == predicate)
    return out if superseded else out.filter(F.coalesce(F.col("status"), F.lit("active")) == "active")


def evidence(rows: DataFrame, sources: DataFrame, support_type: str | None = None) -> DataFrame:
    """Evidence with its source's title; rows without a source come back with a null title."""
    out = rows if support_type is None else rows.filter(F.col("support_type") == support_type)
    return out.join(sources.select(F.col("record_id").alias("source_id"), F.col("title").alias("source_title")), "source_id", "left")


def unresolved(mentions: DataFrame) -> DataFrame:
    return mentions.filter(F.col("entity_id").isNull())
