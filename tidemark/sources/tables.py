"""Record frames over plain tables: nodes, statements, sources, evidence, identifiers and a ledger of daily batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, ledger


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user on each day as that record's state in the day's batch."""
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    # arg-max aggregation instead of a window: partial results before the shuffle, so a busy user's rows don't meet in a task
    last = e.groupBy("user_id", "day").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last.join(event_batches(spark, sf_dir).select("day", "commit_order"), "day").select(
        F.lit("user").alias("class"), key("user", "user_id").alias("record_id"), "commit_order", "event_type"
    )


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each day with events; the number of days is small by nature."""
    days = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    numbered = days.withColumn("commit_order", F.row_number().over(W.orderBy("day")))
    return numbered.select(
        "day", "commit_order", F.concat(F.lit("batch:"), F.col("day").cast("string")).alias("batch_id"), F.col("day").cast("timestamp_ntz").alias("committed_at"), F.lit("committed").alias("status"), F.lit("schema:1").alias("schema_digest")
    )


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.observe(event_states(spark, sf_dir), ["event_type"])


def event_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.revisions_of(event_observations(spark, sf_dir))


NODE_TABLES = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name"), "orders": ("o_orderkey", "o_orderstatus")}
LINKS = {"nation": ("n_nationkey", "in_region", "region", "n_regionkey"), "customer": ("c_custkey", "in_nation", "nation", "c_nationkey"), "supplier": ("s_suppkey", "in_nation", "nation", "s_nationkey"), "orders": ("o_orderkey", "placed_by", "customer", "o_custkey")}


def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, class, label, role of the node tables, documents (sources) and labels (evidence)."""
    parts = [read(spark, sf_dir, t).select(key(t, k).alias("record_id"), F.lit(t).alias("class"), F.col(label).alias("label"), F.lit("node").alias("role")) for t, (k, label) in NODE_TABLES.items()]
    parts.append(read(spark, sf_dir, "documents").select(key("doc", "doc_id").alias("record_id"), F.lit("document").alias("class"), F.col("source").alias("label"), F.lit("source").alias("role")))
    parts.append(read(spark, sf_dir, "labels").select(key("label", "doc_id").alias("record_id"), F.lit("label").alias("class"), F.lit("label").alias("label"), F.lit("evidence").alias("role")))
    return reduce(DataFrame.unionByName, parts)


def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [graph.edges(read(spark, sf_dir, t), key(t, k), F.lit(p), key(to, fk), t, "semantic") for t, (k, p, to, fk) in LINKS.items()]
    return reduce(DataFrame.unionByName, parts)


def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return graph.edges(items, key("orders", "l_orderkey"), F.lit("contains"), key("part", "l_partkey"), "lineitem", "semantic")


def provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(read(spark, sf_dir, "labels"), key("label", "doc_id"), F.lit("evidence_source"), key("doc", "doc_id"), "label", "provenance")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements: subject customer, object by status, `about` the parts of the order."""
    orders = read(spark, sf_dir, "orders")
    about = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(key("part", "l_partkey"))).alias("about"))
    status = F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "P", "retracted").otherwise("active")
    joined = orders.join(about, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.lit("order").alias("class"), key("order", "o_orderkey").alias("record_id"), key("customer", "o_custkey").alias("subject"), F.lit("ordered").alias("predicate"),
        F.lit(None).cast("string").alias("object_entity"), F.col("o_orderpriority").alias("object_value"), "about", status.alias("status"), F.col("o_orderdate").alias("asserted_at"),
    )


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = F.when(F.col("toxic") == 1, "contradicts").when(F.col("quality") == 1, "supports").otherwise("mentions")
    return read(spark, sf_dir, "labels").select(key("label", "doc_id").alias("record_id"), key("doc", "doc_id").alias("source_id"), support.alias("support_type"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(key("doc", "doc_id").alias("record_id"), F.col("source").alias("title"), "lang")


def page_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.lit("page").alias("class"), key("page", "page_id").alias("record_id"), F.lit("canonical_url").alias("namespace"), F.col("url").alias("value"), F.col("page_id").alias("first_order"))
