"""The pipeline's stages on the smallest table, each against what it must keep and drop."""

import collections

import pyarrow.dataset as ds

import corpus_pipeline
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.count())
    assert seen[0] == seen[1] == seen[2] > seen[3] > seen[4] > 0
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "3")).select("doc_id").collect()}
    pieces = docs.groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in pieces} == kept
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == seen[-1]


def test_queries_are_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_leaks_match_plain_search(spark):
    bench = ds.dataset(f"{SF}/benchmark.parquet").to_table().to_pandas()
    docs = ds.dataset(f"{SF}/documents.parquet").to_table().to_pandas()
    squeeze = lambda t: " ".join(t.lower().split())
    whole = {(d, i) for d, t in zip(docs.doc_id, docs.text, strict=True) for i, b in zip(bench.item_id, bench.text, strict=True) if squeeze(b) in squeeze(t)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.queries()["op9_decontamination"](spark, SF).collect()}
    assert whole <= got and collections.Counter(d for d, _ in got)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, a column that clashes, and no rows at all, through all stages."""
    clean = "A quiet river ran below the old stone bridge while the miller counted sacks of grain until the evening bells"
    rows = [(1, clean, "en", "a"), (1, clean, "en", "a"), (None, clean + " rang", "en", "b"), (2, None, "en", "b"), (3, "", None, "b"), (4, "123 456", "en", "b"), (5, "Another text entirely about ships\nand sails", "en", "a"), (6, "and sails", "en", None), (7, " ".join(f"w{i}x" for i in range(5000)), "en", "c")]
    schema = "doc_id long, text string, lang string, label string"
    for name, table in (("odd", rows), ("empty", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(table, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, "Another text entirely about ships"), (None, "x")] if table else [], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        kept = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path / name))
            kept.append(sorted(((r["doc_id"], r["text"][:12]) for r in docs.collect()), key=str))
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path / name)).collect()
        if not table:
            assert kept == [[]] * 4 and packed == []
            continue
        assert kept[0] == [(1, clean[:12]), (1, clean[:12]), (5, "Another text"), (6, "and sails"), (7, "w0x w1x w2x "), (None, clean[:12])]
        assert kept[1] == [(1, clean[:12]), (1, clean[:12]), (5, "Another text"), (6, ""), (7, "w0x w1x w2x "), (None, clean[:12])]
        assert kept[2] == [(1, clean[:12]), (5, "Another text"), (6, ""), (7, "w0x w1x w2x ")]
        assert kept[3] == [(1, clean[:12]), (6, ""), (7, "w0x w1x w2x ")]
        assert {r["doc_id"] for r in packed} == {1, 6, 7}
