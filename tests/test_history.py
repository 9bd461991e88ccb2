"""Boundaries, contracts that grow, plans beside other commits, reviews, numbered issues."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.test_store import TABLES, orgs, people
from tidemark.errors import HistoryError, InvalidPlanError, SnapshotBoundaryError, SnapshotError, StalePlanError
from tidemark.operators import files
from tidemark.plans.plan import Provenance, commit, discard, ingest, plan
from tidemark.sources import contract as C
from tidemark.sources.store import Store

SHOP = {
    "name": "shop",
    "tables": [
        {"name": "shelf", "columns": [{"name": "id", "type": "string", "constraints": ["primary_key"]}, {"name": "aisle", "type": "integer"}]},
        {
            "name": "tool",
            "columns": [
                {"name": "id", "type": "string", "constraints": ["primary_key"]},
                {"name": "label", "type": "string", "constraints": ["required"]},
                {"name": "weight", "type": "number"},
                {"name": "shelf", "type": "string", "constraints": ["foreign_key"], "references": {"table": "shelf", "column": "id"}},
            ],
        },
    ],
}


def contract(**more):
    """The shop's contract; more: columns that tools have beside."""
    own = json.loads(json.dumps(SHOP))
    own["tables"][1]["columns"] += [{"name": k, **v} for k, v in more.items()]
    return C.from_table_dictionary(json.dumps(own))


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, f"file://{tmp_path}/store", contract())


def tools(spark, *rows):
    return {"tool": spark.createDataFrame([(i, label, None, None) for i, label in rows], "id string, label string, weight string, shelf string")}


def test_boundaries(spark, store):
    ingest(store, tools(spark, ("t1", "saw")), Provenance("p", "1"), "2024-01-01T10:00:00")
    first = store.snapshot()
    ingest(store, tools(spark, ("t1", "axe")), Provenance("p", "2"), "2024-01-02T10:00:00")
    assert [store.boundary(x) for x in ("2023-01-01", "2024-01-01T10:00:00", "2024-01-01T12:00:00+02:00", "2024-01-02T09:59:59Z", "2030-01-01")] == [0, 1, 1, 1, 2]
    assert store.boundary(first.batch_id) == 1
    for odd in ("batch-x", "", "yesterday", "2024-13-01"):
        with pytest.raises(HistoryError) as e:
            store.history(as_of=odd)
        assert e.value.rule == "history_boundary"
    view = store.at(first)
    assert view.boundary("2024-01-01T10:00:00") == 1 and view.boundary("2023-01-01") == 0
    for late in (store.snapshot().batch_id, "2024-01-01T10:00:01", "2099-01-01"):
        with pytest.raises(SnapshotBoundaryError):
            view.boundary(late)


@pytest.mark.parametrize("more, fits", [({"colour": {"type": "string"}}, True), ({"colour": {"type": "string", "constraints": ["required"]}}, False), ({}, True)])
def test_contracts_that_grow(spark, store, more, fits):
    ingest(store, tools(spark, ("t1", "saw")), Provenance("p", "1"), "2024-01-01T10:00:00")
    grown = contract(**more)
    if more:
        with pytest.raises(SnapshotError):
            Store.open(spark, store.path, grown)
    if not fits:
        with pytest.raises(SnapshotError):
            Store.open(spark, store.path, grown, evolve=True)
        return
    assert Store.open(spark, store.path, grown, evolve=True).records("tool").count() == 1
    assert not store.contract.extends(grown) or not more


def test_revisions_by_their_own_contract(spark, store):
    ingest(store, tools(spark, ("t1", "saw"), ("t2", "axe")), Provenance("p", "1"), "2024-01-01T10:00:00")
    pin = store.snapshot()
    second = Store.open(spark, store.path, contract(colour={"type": "string"}, price={"type": "string", "display": "restricted"}), evolve=True)
    rows = spark.createDataFrame([("t1", "saw", "2.5", "red", "9")], "id string, label string, weight string, colour string, price string")
    ingest(second, {"tool": rows}, Provenance("p", "2"), "2024-01-02T10:00:00")
    got = {(r["record_id"], r["revision_number"]): r for r in second.revised("tool").collect()}
    assert got["t1", 1]["fields"] == ["label", "shelf", "weight"] == got["t1", 1]["changed_fields"] and got["t1", 1]["colour"] is None
    assert got["t1", 2]["fields"] == ["colour", "label", "shelf", "weight"] and got["t1", 2]["changed_fields"] == ["colour", "weight"]
    assert (got["t1", 2]["colour"], got["t1", 2]["weight"]) == ("red", 2.5) and "price" not in second.revised("tool").columns
    assert len(got) == 3 and second.revised("tool", "t1", as_of="2024-01-01T12:00:00").count() == 1
    # the older contract can't write any more, but a view of its time reads by it
    with pytest.raises(SnapshotError):
        Store.open(spark, store.path, contract())
    assert "colour" not in second.at(pin).records("tool").columns
    # a contract that is gone stops the read
    second.files.remove(f"contracts/{contract().build_digest().split(':')[1]}.json")
    with pytest.raises(Exception, match="no contract"):
        second.revised("tool").collect()


def test_plans_beside_other_commits(spark, store):
    mine = plan(store, tools(spark, ("t1", "saw")), Provenance("me", "1"))
    late = plan(store, tools(spark, ("t2", "hoe")), Provenance("me", "2"))
    again = plan(store, tools(spark, ("t2", "axe")), Provenance("you", "2"))
    ingest(store, tools(spark, ("t2", "axe")), Provenance("you", "1"), "2024-01-01T00:00:00")
    assert commit(store, mine, "2024-01-02T00:00:00") == {"insert": 1}
    for stale in (late, again):
        with pytest.raises(StalePlanError) as e:
            commit(store, stale, "2024-01-03T00:00:00")
        assert (e.value.rule, e.value.field) == ("touched", "t2")
    assert [c.commit_order for c in store.commits()] == [1, 2] and store.broken_log().count() == 0
    assert store.files.names("staging") == []
    # a replay leaves nothing behind either; a refused plan waits for its issues to be read
    assert commit(store, plan(store, tools(spark, ("t1", "saw")), Provenance("me", "1")), "2024-01-04T00:00:00") == {"insert": 1}
    bad = plan(store, tools(spark, ("t3", " ")), Provenance("me", "3"))
    with pytest.raises(InvalidPlanError):
        commit(store, bad, "2024-01-04T00:00:00")
    assert bad.issues.count() == 1 and len(store.files.names("staging")) == 1
    discard(store, bad)
    assert store.files.names("staging") == []
    # plans of an order that the store doesn't have
    with pytest.raises((StalePlanError, InvalidPlanError)):
        commit(store, replace(plan(store, tools(spark, ("t4", "x")), Provenance("me", "4")), base_order=9), "2024-01-05T00:00:00")


def test_two_writers_of_one_order(spark, store):
    """The second of two commits that took the same order leaves no files, and what the first wrote stays."""
    ingest(store, tools(spark, ("t1", "saw")), Provenance("p", "1"), "2024-01-01T00:00:00")
    made = store.commits()[0]
    rows = {n: store._table(n) for n in ("revisions", "observations", "identifiers", "origins")}
    with pytest.raises(StalePlanError):
        store.publish(made, "", *rows.values())
    assert len(store.files.names("revisions")) == 1 and store.records("tool").count() == 1


def test_issues_are_numbered(spark, store):
    n = 40
    tool = spark.range(n).select(F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("id") % 7 == 3, " ").otherwise("x").alias("label"), F.when(F.col("id") % 5 == 1, "1e999").otherwise("2").alias("weight"), F.when(F.col("id") % 11 == 2, "s9").alias("shelf"))
    tool = tool.repartitionByRange(6, F.substring("id", 2, 9).cast("int")).sortWithinPartitions(F.substring("id", 2, 9).cast("int"))
    shelf = spark.createDataFrame([("s1", "1"), ("s1", "x"), ("s2", "3")], "id string, aisle string").coalesce(1)
    got = [tuple(r) for r in plan(store, {"tool": tool, "shelf": shelf}, Provenance("p", "1")).issues.select("class", "input_row", "record_id", "field", "rule", "condition_class").collect()]
    want = [("shelf", 1, "s1", "id", "unique_batch_id", "identity_error"), ("shelf", 2, "s1", "aisle", "type_integer", "validation_error"), ("shelf", 2, "s1", "id", "unique_batch_id", "identity_error")]
    for i in range(n):
        row = ("tool", i + 1, f"t{i}")
        want += [(*row, "label", "required", "validation_error")] * (i % 7 == 3) + [(*row, "shelf", "reference_exists", "reference_error")] * (i % 11 == 2) + [(*row, "weight", "type_double", "validation_error")] * (i % 5 == 1)
    assert got == want


def test_reviews_refuse_what_they_cannot_propose(spark, store, tmp_path):
    ingest(store, tools(spark, *[(f"t{i}", f"tool {i}") for i in range(6)]), Provenance("p", "1"), "2024-01-01T00:00:00")
    tree = f"file://{tmp_path}/tree"
    files.sync(store, tree)
    pages = spark.read.schema("record_id string, content string, class string").json(tree).cache()
    pages.count()
    ingest(store, tools(spark, ("t1", "moved"), ("t2", "same"), ("t7", "new")), Provenance("p", "2"), "2024-01-02T00:00:00")

    def work(name, change, more=None):
        out = pages.withColumn("content", change)
        (out if more is None else more(out)).write.mode("overwrite").partitionBy("class").json(f"file://{tmp_path}/{name}")
        return f"file://{tmp_path}/{name}"

    def label(of):
        """The pages with other labels, by record."""
        change = F.col("content")
        for k, v in of.items():
            change = F.when(F.col("record_id") == k, F.regexp_replace("content", "(?m)^label: .*$", f'label: {{"v":"{v}"}}')).otherwise(change)
        return change

    kinds = lambda path: {r["record_id"]: r["kind"] for r in files.compare(store, path).collect()}
    fine = work("fine", label({"t0": "edited"}))
    assert kinds(fine) == {"t0": "edited", "t1": "behind", "t2": "behind", "t3": "unchanged", "t4": "unchanged", "t5": "unchanged", "t7": "new_in_store"}
    assert {(r["record_id"], r["action"]) for r in files.review(store, fine, Provenance("r", "1")).changes.collect()} == {("t0", "update"), ("t3", "match"), ("t4", "match"), ("t5", "match")}
    cases = {
        "stale_base": work("stale", label({"t1": "mine"})),
        "removed": work("removed", F.col("content"), lambda df: df.filter("record_id <> 't3'")),
        "repeated": work("repeated", F.col("content"), lambda df: df.unionByName(df.filter("record_id = 't4'"))),
        "lost_base": work("lost", F.col("content"), lambda df: df.unionByName(df.filter("record_id = 't4'").withColumn("record_id", F.lit("t99")))),
    }
    for rule, path in cases.items():
        with pytest.raises(InvalidPlanError) as e:
            files.review(store, path, Provenance("r", rule))
        assert e.value.rule == rule


def test_a_plan_by_supplied_ids_is_staged_once(spark, tmp_path):
    """Its candidates are written with their changes, and nothing is dealt out to find that no id repeats and no reference is broken."""
    store = Store.open(spark, f"file://{tmp_path}/store", C.from_table_dictionary(TABLES))
    good = plan(store, {"organization": orgs(spark, ("o1", "Planet")), "person": people(spark, ("p1", "Lois", "senior", "33", "o1"))}, Provenance("p", "1"))
    assert good.valid and [n for n in store.files.names(good.folder.removeprefix(f"{store.path}/"))] == ["changes"]
    twice = [("p1", "Lois", "senior", "33", "o1"), ("p1", "Lane", "senior", "33", "none"), ("p2", "Clark", "senior", "33", "none")]
    bad = plan(store, {"organization": orgs(spark, ("o1", "Planet")), "person": people(spark, *twice)}, Provenance("p", "2"))
    found = sorted((r["rule"], r["input_row"]) for r in bad.issues.collect())
    assert found == [("reference_exists", 2), ("reference_exists", 3), ("unique_batch_id", 1), ("unique_batch_id", 2)]
