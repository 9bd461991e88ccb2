"""Contracts, plans, commits, replays, boundaries and streams on a small store."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ContractError, InvalidPlanError, ReferenceError_, ReplayConflictError, SnapshotError, StalePlanError
from tidemark.plans.plan import ORIGIN, Provenance, commit, ingest, plan
from tidemark.sources import contract as C
from tidemark.sources.store import Snapshot, Store
from tidemark.streaming.ingest import ingest_stream

TABLES = json.dumps(
    {
        "name": "directory",
        "tables": [
            {"name": "organization", "columns": [{"name": "id", "type": "string", "constraints": ["primary_key", "required"]}, {"name": "name", "type": "string", "constraints": ["required"]}]},
            {
                "name": "person",
                "columns": [
                    {"name": "id", "type": "string", "constraints": ["primary_key", "required"]},
                    {"name": "full_name", "type": "string", "constraints": ["required"]},
                    {"name": "level", "type": "enum", "values": ["junior", "senior"]},
                    {"name": "age", "type": "integer", "range": {"min": 0, "max": 150}},
                    {"name": "notes", "type": "string", "display": "restricted"},
                    {"name": "employer", "type": "string", "constraints": ["foreign_key"], "references": {"table": "organization", "column": "id"}},
                ],
            },
        ],
    }
)
LINKML = """
name: knowledge
default_range: string
slots:
  id: {identifier: true, range: uriorcurie}
  label: {range: string}
  doi: {range: string, annotations: {x.external_identifier: {tag: x.external_identifier, value: doi}}}
enums:
  Kind: {permissible_values: {a: {}, b: {}}}
classes:
  Thing: {abstract: true, slots: [id], annotations: {x.role: node, x.id_policy: resolve_exact}}
  Source: {is_a: Thing, slots: [label, doi], annotations: {x.role: source, x.origin_key_slots: doi}}
  Claim:
    is_a: Thing
    attributes:
      about: {range: Thing, multivalued: true, required: true}
      kind: {range: Kind}
      score: {range: float, minimum_value: 0, maximum_value: 1}
    annotations: {x.role: statement, x.id_policy: mint}
"""


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, f"file://{tmp_path}/store", C.from_table_dictionary(TABLES))


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, full_name string, level string, age string, employer string")


def orgs(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, name string")


def test_contracts():
    own = C.from_table_dictionary(TABLES)
    assert own["person"].slot("employer").reference == "organization" and own["person"].slot("notes").sensitive
    assert own["person"].struct_type()["age"].dataType.typeName() == "long"
    assert C.Contract.from_json(own.to_json()).structural_digest() == own.structural_digest()
    linked = C.from_linkml(LINKML)
    assert linked["Claim"].role == "statement" and linked["Claim"].slot("about").multivalued
    assert linked["Source"].id_policy == "resolve_exact" and linked["Source"].slot("doi").namespace == "doi"
    assert set(linked.takes("Thing")) == {"Source", "Claim"} and not own.compatible(linked)


@pytest.mark.parametrize(
    "change",
    [("integer", "map(string)"), ('"id", "type": "string"', '"key", "type": "string"'), ('"column": "id"', '"column": "name"'), ('["junior", "senior"]', '["junior", "junior"]')],
)
def test_bad_contracts_are_refused(change):
    with pytest.raises(ContractError):
        C.from_table_dictionary(TABLES.replace(*change))
    with pytest.raises(ContractError):
        C.from_table_dictionary('{"name": "x", "name": "y", "tables": []}')
    with pytest.raises(ContractError):
        C.from_linkml(LINKML.replace("is_a: Thing\n", "is_a: Thing\n    mixins: [Source]\n"))


def test_plan_commit_history_and_replay(spark, store):
    first = {"organization": orgs(spark, ("o1", "Planet")), "person": people(spark, ("p1", "Lois", "senior", "33", "o1"), ("p2", "Clark", "junior", None, "o1"))}
    made = plan(store, first, Provenance("import", "k1"))
    assert made.valid and commit(store, made, "2024-01-01T00:00:00") == {"insert": 3}
    assert commit(store, made, "2024-01-01T00:00:00") == {"insert": 3} and len(store.commits()) == 1
    pin = store.snapshot()
    second = {"person": people(spark, ("p1", "Lois", "senior", "34", "o1"), ("p2", "Clark", "junior", None, "o1"))}
    assert ingest(store, second, Provenance("import", "k2"), "2024-01-02T00:00:00") == {"update": 1, "match": 1}
    with pytest.raises(ReplayConflictError):
        ingest(store, first, Provenance("import", "k2"), "2024-01-03T00:00:00")
    assert store.get("p1")["record"]["age"] == "34" and "notes" not in store.get("p1")["record"]
    view = store.at(Snapshot(**json.loads(pin.to_json())))
    assert view.get("p1")["record"]["age"] == "33"
    assert [r["revision_number"] for r in store.history("p1").collect()] == [2, 1]
    assert [r["revision_number"] for r in store.history("p1", as_of="2024-01-01T12:00:00").collect()] == [1]
    assert {r["record_id"]: r["age"] for r in store.records("person").collect()} == {"p1": 34, "p2": None}
    assert [r["record_id"] for r in store.find("LOI", "person").collect()] == ["p1"]
    assert store.audit().collect() == []
    with pytest.raises(ReferenceError_):
        store.get("nobody")
    with pytest.raises(SnapshotError):
        store.at(Snapshot("elsewhere", 1, "b", "", ""))


def test_issues_instead_of_errors(spark, store):
    bad = {
        "organization": orgs(spark, ("o1", " ")),
        "person": people(spark, ("p1", "Lois", "chief", "-1", "o9"), ("p2", None, None, "x", "p1"), ("p3", "Ann", None, None, "o1"), ("p3", "Ann", None, None, "o1"), (None, "No id", None, None, None)),
    }
    made = plan(store, bad, Provenance("import", "bad"))
    rules = {(r["record_id"], r["field"], r["rule"]) for r in made.issues.collect()}
    assert {
        ("o1", "name", "required"), ("p1", "level", "enum_membership"), ("p1", "age", "minimum_value"), ("p1", "employer", "reference_exists"), ("p2", "full_name", "required"),
        ("p2", "age", "type_integer"), ("p2", "employer", "reference_class"), ("p3", "id", "unique_batch_id"), (None, "id", "required_internal_id"),
    } == rules
    with pytest.raises(InvalidPlanError):
        commit(store, made, "2024-01-01T00:00:00")
    assert store.commits() == []


def test_stale_plan_and_other_contract(spark, store):
    a = plan(store, {"organization": orgs(spark, ("o1", "A"))}, Provenance("x", "a"))
    b = plan(store, {"organization": orgs(spark, ("o1", "B"))}, Provenance("x", "b"))
    commit(store, a, "2024-01-01T00:00:00")
    with pytest.raises(StalePlanError):
        commit(store, b, "2024-01-01T00:00:00")
    with pytest.raises(SnapshotError):
        Store.open(spark, store.path, C.from_linkml(LINKML))


def test_identifiers_and_minted_ids(spark, tmp_path):
    own = Store.open(spark, f"file://{tmp_path}/k", C.from_linkml(LINKML))
    rows = spark.createDataFrame([("A", "https://doi.org/10.1/X"), ("B", "10.1/y")], "label string, doi string")
    assert ingest(own, {"Source": rows}, Provenance("p", "1"), "2024-01-01T00:00:00") == {"insert": 2}
    assert {r["normalized"] for r in own.identifiers().collect()} == {"10.1/x", "10.1/y"}
    again = spark.createDataFrame([("s9", "C", "doi:10.1/x")], "id string, label string, doi string")
    rules = {r["rule"] for r in plan(own, {"Source": again}, Provenance("p", "2")).issues.collect()}
    assert rules == {"consistent_exact_identity", "internal_external_identity_agreement"}
    # without an id, the same identifier in another spelling is the same record
    met = plan(own, {"Source": spark.createDataFrame([("A2", "DOI: 10.1/x"), ("New", "10.1/z"), ("New", "doi:10.1/z ")], "label string, doi string")}, Provenance("p", "3"))
    assert sorted((r["action"], r["reason"]) for r in met.changes.collect()) == [("insert", "exact_identifier_mint"), ("insert", "exact_identifier_mint"), ("update", "identifier")]
    assert {r["rule"] for r in met.issues.collect()} == {"unique_batch_id"}


def test_origins_meet_their_records(spark, tmp_path):
    own = Store.open(spark, f"file://{tmp_path}/k", C.from_linkml(LINKML))
    source = spark.createDataFrame([("s1", "A", "10.1/x")], "id string, label string, doi string")
    schema = f"id string, about array<string>, kind string, score string, `{ORIGIN}` string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert ingest(own, {"Source": source, "Claim": rows((None, ["s1"], "a", "0.5", "k1"), (None, ["s1"], "b", "0.5", "k2"))}, Provenance("p", "1"), "2024-01-01T00:00:00") == {"insert": 3}
    again = {"Claim": rows((None, ["s1"], "a", "0.75", "k1"), (None, ["s1"], "b", "0.5", "k3"))}
    assert ingest(own, again, Provenance("p", "2"), "2024-01-02T00:00:00") == {"update": 1, "insert": 1}
    # another producer's keys are its own
    assert sorted(r["action"] for r in plan(own, again, Provenance("q", "1")).changes.collect()) == ["insert", "insert"]
    assert own.audit().collect() == []


def test_tampered_plans_and_read_only_stores(spark, store):
    made = plan(store, {"organization": orgs(spark, ("o1", "A"))}, Provenance("x", "a"))
    for odd in (replace(made, changes=made.changes.withColumn("payload", F.lit("{}"))), replace(made, base_order=7), replace(made, provenance=Provenance("y", "a"))):
        with pytest.raises(InvalidPlanError):
            commit(store, odd, "2024-01-01T00:00:00")
    commit(store, made, "2024-01-01T00:00:00")
    reader = Store.open(spark, store.path, store.contract, read_only=True)
    assert reader.get("o1")["record"]["name"] == "A"
    with pytest.raises(SnapshotError):
        ingest(reader, {"organization": orgs(spark, ("o2", "B"))}, Provenance("x", "b"), "2024-01-02T00:00:00")
    with pytest.raises(ReferenceError_):
        Store.open(spark, store.path + "-none", store.contract, read_only=True)


def test_stream_is_committed_once(spark, store, tmp_path):
    orgs(spark, ("o1", "A"), ("o2", "B")).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("id string, name string").parquet(str(tmp_path / "in"))
        ingest_stream(store, stream, "organization", "feed", str(tmp_path / "check")).awaitTermination(60)
    assert len(store.commits()) == 1 and store.heads().filter(F.col("class") == "organization").count() == 2
