"""Batches and answers that are larger than what fits a broadcast or a page."""

import os

import duckdb
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import files
from tidemark.plans import plan as plans
from tidemark.sources.contract import from_linkml
from tidemark.sources.store import Store


def broadcast_scans(df):
    """The scans of staged files that a plan broadcasts without a shuffle between."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        depth = line.index("BroadcastExchange")
        for below in lines[i + 1 :]:
            node = below.lstrip(" :+-|*()0123456789")
            if len(below) - len(node) <= depth or node.startswith("Exchange hashpartitioning"):
                break
            found += [below] if node.startswith("FileScan") and "/staged" in node else []
    return found


def test_a_large_batch_is_dealt_by_key(spark, tmp_path, monkeypatch):
    store = Store.open(spark, f"file://{tmp_path}/s", from_linkml(queries.CATALOG))
    rows = spark.range(200).select(F.lit("same").alias("label"), F.col("id").cast("string").alias(plans.ORIGIN))
    plans._staged(store.contract["Item"], rows).withColumn("candidate", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/staged")
    read = lambda: spark.read.parquet(f"file://{tmp_path}/staged")
    made = lambda staged: staged.join(plans.resolve(store, staged, "p"), "candidate")
    assert broadcast_scans(made(read()))  # what Spark does by the size of the files
    monkeypatch.setattr(plans, "DEALT", 100)
    large = made(plans.dealt(read()))
    assert not broadcast_scans(large)
    assert large.select("record_id").distinct().count() == 200 and large.filter(F.size("odd") > 0).isEmpty()


def test_all_evidence_counts_beyond_a_page(spark, tmp_path):
    few = "/root/testdata/sf0.001"
    for name in os.listdir(few):
        os.symlink(f"{few}/{name}", tmp_path / name)
    ids = pa.array([50 * i + 7 for i in range(2101)])  # all of them are evidence for a claim about one customer
    documents = {"doc_id": ids, "text": ["x"] * len(ids), "lang": ["en"] * len(ids), "source": ["web"] * len(ids), "n_chars": [1] * len(ids)}
    for name, columns in (("documents", documents), ("labels", {"doc_id": ids, "quality": [1] * len(ids), "toxic": [0] * len(ids)})):
        os.unlink(tmp_path / f"{name}.parquet")
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    con = duckdb.connect()
    for p in tmp_path.glob("*.parquet"):
        con.register(p.stem, ds.dataset(str(p)).to_table())
    got = {(r["part"], r["n"]) for r in queries.store_get(spark, str(tmp_path)).collect()}
    assert got == set(con.sql(queries.SQL["store_get"]).fetchall()) and ("evidence", 2101) in got


def test_pages_are_read_by_few_tasks(spark, tmp_path):
    class Here:
        pass

    store = Here()
    store.spark = spark
    pages = spark.range(120).select(F.concat(F.lit("---\nid: "), F.col("id"), F.lit("\n---\n")).alias("value"), F.lit("a=b").alias("class"), F.concat(F.lit("p_3A"), F.col("id")).alias("page"))
    index = spark.createDataFrame([("---\ncommit_order: 1\n---\n", files.INDEX, "batch")], "value string, class string, page string")
    files.write_pages(pages.unionByName(index), f"file://{tmp_path}/tree")
    (tmp_path / "tree" / "class=a%3Db" / "page=p_3A7" / ".other.crc").write_text("no page")
    spark.sparkContext.setJobGroup("pages", "pages")
    got = files.edited(store, f"file://{tmp_path}/tree").collect()
    spark.sparkContext.setJobGroup("", "")
    assert {(r["class"], r["record_id"], r["content"]) for r in got} == {("a=b", str(i), f"---\nid: {i}\n---\n") for i in range(120)} and len(got) == 120
    known = spark.sparkContext.statusTracker()
    stages = [s for j in known.getJobIdsForGroup("pages") for s in known.getJobInfo(j).stageIds]
    assert sum(known.getStageInfo(s).numTasks for s in stages if known.getStageInfo(s)) < 60  # one for each folder before
    plain = spark.read.schema("value string, class string, page string").text(f"file://{tmp_path}/tree", wholetext=True)
    assert plain.filter(F.col("class") == "a=b").select("value", "page").distinct().count() == 120  # Spark reads the same tree
    assert [r["content"] for r in files._tree(store, f"file://{tmp_path}/tree", index=True).collect()] == ["---\ncommit_order: 1\n---\n"]
