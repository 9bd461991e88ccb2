import pytest

from tidemark.errors import MeasureError
from tidemark.operators.measures import Measure, column, evaluate, issues

COLUMNS = ["amount", "species", "site"]


@pytest.mark.parametrize("expr", ["SUM(amount)", "COUNT(*)", "count(distinct species)", "SUM(amount) / COUNT(*)", "AVG(amount * 2 + 1)", "MIN((amount))", "SUM(amount) > 10 AND COUNT(*) < 5", "COUNT(*) = 0 OR NOT TRUE", "MAX(site != 'ridge')", "SUM(-amount)", "SUM(amount) - -1", "SUM(amount) --1", "SUM(amount) / (COUNT(*) - 3)", "SUM((site = 'c') = (amount = 3))", "NOT COUNT(*) = 2"])
def test_accepted(expr):
    assert issues(expr, COLUMNS) == []


@pytest.mark.parametrize(
    ("expr", "rule"),
    [("LOWER(species)", "measure_expr_function"), ("SUM(missing)", "measure_expr_column"), ("SUM(DISTINCT amount)", "measure_expr_distinct"), ("SUM(amount", "measure_expr_parse"), ("SUM(amount)) ", "measure_expr_parse"), ("amount ;", "measure_expr_parse"), ("", "measure_expr_parse"), ("SUM(COUNT(*))", "measure_expr_nested"), ("amount", "measure_expr_aggregate"), ("SUM(amount) + amount", "measure_expr_aggregate"), ("SUM(amount = 1 = 1)", "measure_expr_parse"), ("SUM(amount) extra", "measure_expr_parse")],
)
def test_refused(expr, rule):
    assert issues(expr, COLUMNS) == [rule]


def test_values(spark):
    rows = spark.createDataFrame([("solvent", 2), ("solvent", 4), ("acid", 0), (None, 1)], "label string, n int")
    m = Measure("m", "x", "SUM(n) / COUNT(*)", parameters={"which": "label"}, dimensions=("label",))
    assert [tuple(r) for r in evaluate(rows, m, by=("label",)).collect()] == [("acid", 0.0), ("solvent", 3.0), (None, 1.0)]
    assert evaluate(rows, m, {"which": "solvent"}).first()["value"] == 3.0
    assert evaluate(rows, Measure("b", "x", "SUM(label = 'acid')")).first()["value"] == 1
    assert evaluate(rows, Measure("z", "x", "COUNT(*) / SUM(n)", dimensions=("label",)), by=("label",)).collect()[0]["value"] is None
    with pytest.raises(MeasureError):
        evaluate(rows, m, by=("n",))
    with pytest.raises(MeasureError):
        column("SUM(label)", {"label": "string"})


def test_several_rules():
    assert issues("SELECT 1", COLUMNS) == ["measure_expr_column", "measure_expr_parse"]
    assert issues("SUM(label + 1)", {"label": "string"}) == ["measure_expr_type"]
    assert issues("SUM(NOT x)", {"x": "int"}) == ["measure_expr_type"]


@pytest.mark.parametrize(
    ("expr", "want"),
    [("SUM(label = 'a/b')", 2), ("SUM(label = 'it''s')", 1), ("SUM(x) --1", 11), ("SUM(x) / (COUNT(*) - 4)", None), ("SUM((label = 'c') = (x = 3))", 4), ("SUM(x) / COUNT(*) / 2", 1.25), ("SUM(x) - 1 - 2", 7), ("2 + 3 * COUNT(*)", 14), ("-MIN(x) + MAX(x * -1)", -2), ("NOT COUNT(*) = 4 OR TRUE AND COUNT(*) < 0", False)],
)
def test_trees(spark, expr, want):
    rows = spark.createDataFrame([("a/b", 1), ("a/b", 2), ("c", 3), ("it's", 4)], "label string, x int")
    assert rows.agg(column(expr, dict(rows.dtypes)).alias("v")).first()["v"] == want
