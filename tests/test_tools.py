"""Search over all classes, and tools with closed schemas."""

import json

import pytest

from tests.test_store import TABLES, orgs, people
from tidemark.errors import HistoryError, LimitError, RecordError
from tidemark.operators.tools import tools
from tidemark.plans.plan import Provenance, ingest
from tidemark.sources import contract as C
from tidemark.sources.knowledge import Knowledge, measured
from tidemark.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    own = Store.open(spark, f"file://{tmp_path}/store", measured(C.from_table_dictionary(TABLES)))
    measure = spark.createDataFrame([("m1", "people", "person", "COUNT(*)", '["level"]')], "id string, name string, target_class string, expr string, dimensions string")
    first = {"organization": orgs(spark, ("o1", 'The "Planet" \\ Daily'), ("o2", "Lunar")), "person": people(spark, ("p1", "Lois Plánet", "senior", "33", "o1"), ("p2", "Ann", "junior", None, "o2"), ("p3", "Planetta", "junior", None, "o2")), "Measure": measure}
    ingest(own, first, Provenance("import", "k1"), "2024-01-01T00:00:00")
    return own


def test_find_over_all_classes(store):
    known = Knowledge(store)
    found = known.find("planet")
    assert [(r["class"], r["id"], r["label"], r["matched_fields"]) for r in found.rows] == [("organization", "o1", 'The "Planet" \\ Daily', ["name"]), ("person", "p3", "Planetta", ["full_name"])]
    assert json.loads(found.rows[1]["record"]) == {"id": "p3", "full_name": "Planetta", "level": "junior", "age": None, "employer": "o2"} and not found.truncated
    assert [r["id"] for r in known.find('"planet" \\ d').rows] == ["o1"] and [r["id"] for r in known.find("PLÁNET").rows] == ["p1"]
    assert [r["id"] for r in known.find("n", "person", 1).rows] == ["p1"] and known.find("n", "person", 1).truncated
    assert known.find("o2").rows == [] and known.find("%").rows == []  # ids and other fields aren't searched, nothing is a pattern
    with pytest.raises(RecordError):
        known.find("  ")


def test_tools_have_closed_schemas(store):
    own = tools(store)
    assert set(own) == {"find", "get", "query", "history", "lookup", "measure"}
    for tool in own.values():
        schema = json.loads(json.dumps(tool.schema()))
        assert schema["additionalProperties"] is False and set(schema["required"]) <= set(schema["properties"])
    odd = [("find", {}), ("find", {"query": 3}), ("find", {"query": "x", "record_class": "nobody"}), ("get", {"id": "o1", "include": ["friends"]}), ("get", {"id": "o1", "limits": {"friends": 1}}), ("query", {"operation": "drop"}), ("measure", {"name": "other"}), ("query", {"operation": "claims", "request": {"sql": "x"}})]
    for name, arguments in odd:
        with pytest.raises(RecordError):
            own[name](**arguments)
    for name, arguments in [("find", {"query": "x", "limit": 0}), ("history", {"id": "p1", "limit": 5000}), ("get", {"id": "o1", "limits": {"claims": 10**6}})]:
        with pytest.raises(LimitError):
            own[name](**arguments)
    got = own["measure"](name="people", by=["level"])
    assert [(r["level"], r["value"]) for r in got["rows"]] == [("junior", 2), ("senior", 1)] and got["receipt"]["definition"] == {"id": "m1", "revision_id": "m1#1"}
    assert own["get"](id="p1", include=["identifiers"])["related"] == {"identifiers": []}
    assert own["query"](operation="claims", request={"id": "p1"})["rows"] == []
    told = own["history"](id="p1", as_of="2024-06-01")["receipt"]["boundary"]
    assert (told["kind"], told["commit_order"]) == ("history", 1)
    with pytest.raises(HistoryError):
        own["history"](id="p1", as_of="some day")
    pinned = tools(store.at(store.snapshot()))
    assert "integrity" not in pinned["query"].schema()["properties"]["operation"]["enum"] and pinned["find"](query="ann")["receipt"]["boundary"]["kind"] == "snapshot"
