"""Tables beyond the bound of a broadcast go by a shuffle, whatever the size of their files."""

from pyspark.sql import functions as F

from tidemark.llm import common


def test_what_is_not_broadcast_is_shuffled(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") * 7).alias("key"))
    table = common.cut_table(spark.range(1000).select(F.col("id").alias("key")))
    plan = lambda how, small: rows.join(small, "key", how)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan("inner", table)  # Spark's own choice
    for how in ("inner", "left_semi", "left_anti"):
        assert "BroadcastExchange" in plan(how, common.by_size(table, 16))
        assert "BroadcastExchange" not in plan(how, common.by_size(table, 16, 8000))
        monkeypatch.setattr(common, "DEALT", 100)
        assert "BroadcastExchange" not in plan(how, common.dealt(table))
        monkeypatch.undo()
