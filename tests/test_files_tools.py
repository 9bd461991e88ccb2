import pytest

from tests.test_store import TABLES, orgs, people
from tidemark.errors import LimitError, RecordError
from tidemark.operators import files
from tidemark.operators.tools import tools
from tidemark.plans.plan import Provenance, commit, ingest
from tidemark.sources import contract as C
from tidemark.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    own = Store.open(spark, f"file://{tmp_path}/store", C.from_table_dictionary(TABLES))
    ingest(own, {"organization": orgs(spark, ("o1", "Planet")), "person": people(spark, ("p1", "Lois: \"L\"", "senior", "33", "o1"))}, Provenance("import", "k1"), "2024-01-01T00:00:00")
    return own


def test_tree_round_trip_and_review(spark, store, tmp_path):
    path = f"file://{tmp_path}/tree"
    exported = files.sync(store, path)
    assert files.status(store, path, exported) == "current"
    same = files.review(store, path, Provenance("edit", "1"))
    assert same.valid and {r["action"] for r in same.changes.collect()} == {"match"}
    edited = files.edited(store, path).selectExpr("class", "record_id", "replace(content, 'Planet', 'Daily Planet') as content").cache()
    edited.count()
    edited.write.mode("overwrite").partitionBy("class").json(f"{path}2")
    assert files.status(store, f"{path}2", exported) == "modified"
    assert commit(store, files.review(store, f"{path}2", Provenance("edit", "2")), "2024-01-02T00:00:00") == {"update": 1, "match": 1}
    assert store.get("o1")["record"]["name"] == "Daily Planet" and files.status(store, path, exported) == "stale"
    with pytest.raises(LimitError):
        files.sync(store, path, limit=1)


def test_tools_are_bounded_and_give_receipts(store):
    own = tools(store.at(store.snapshot()))
    found = own["find"](query="lois", record_class="person")
    assert [r["record_id"] for r in found["rows"]] == ["p1"] and not found["truncated"]
    assert found["receipt"]["boundary"]["kind"] == "snapshot" and found["receipt"]["boundary"]["commit_order"] == 1
    assert own["get"](id="o1")["record"] == {"id": "o1", "name": "Planet"}
    assert own["history"](id="p1")["rows"][0]["operation"] == "insert"
    assert own["lookup"](namespace="doi", value="10.1/x")["rows"] == []
    with pytest.raises(LimitError):
        own["history"](id="p1", limit=5000)
    with pytest.raises(RecordError):
        own["get"](id="o1", sql="select 1")


def test_sync_takes_a_store_of_any_size(spark, tmp_path):
    """The default had refused more than 10,000 records."""
    own = Store.open(spark, f"file://{tmp_path}/store", C.from_table_dictionary(TABLES))
    many = spark.range(10_001).selectExpr("concat('o', id) as id", "concat('name ', id) as name")
    ingest(own, {"organization": many}, Provenance("import", "k1"), "2024-01-01T00:00:00")
    files.sync(own, f"file://{tmp_path}/tree")
    assert files.edited(own, f"file://{tmp_path}/tree").count() == 10_001
