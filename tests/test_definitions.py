"""Definitions: measures in plans, seeding, numbers in JSON, schemas that import others."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ContractError
from tidemark.operators import measures
from tidemark.operators.integrity import unsafe_numbers
from tidemark.plans.plan import Provenance, ingest, plan, seed_measures
from tidemark.sources import contract as C
from tidemark.sources.knowledge import Knowledge, measured
from tidemark.sources.store import Store

YARD = {
    "name": "yard",
    "tables": [
        {
            "name": "boat",
            "columns": [
                {"name": "id", "type": "string", "constraints": ["primary_key"]}, {"name": "kind", "type": "string"}, {"name": "length", "type": "number"}, {"name": "built", "type": "date"},
                {"name": "tags", "type": "list(string)"}, {"name": "owner", "type": "string", "display": "restricted"},
            ],
            "definitions": [{"name": "mean length", "label": "Mean length", "description": "of all boats", "expr": "AVG(length)"}],
        }
    ],
}
MEASURES = "id string, name string, title string, description string, target_class string, expr string, parameters string, dimensions string"


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, f"file://{tmp_path}/store", measured(C.from_table_dictionary(json.dumps(YARD))))


def parameter(**more):
    return json.dumps([{"name": "k", "type": "string", "description": "which", "column": "kind"} | more])


def test_measures_are_judged_in_the_plan(spark, store):
    rows = [
        ("boat", "AVG(length)", parameter(), '["kind", "built"]', set()),
        ("ship", "AVG(length)", None, None, {("target_class", "measure_target_class")}),
        ("Measure", "COUNT(*)", None, None, {("target_class", "measure_target_class")}),
        ("boat", "AVG(kind) + owner", None, None, {("expr", "measure_expr_type"), ("expr", "measure_expr_column"), ("expr", "measure_expr_aggregate")}),
        ("boat", "AVG(", None, None, {("expr", "measure_expr_parse")}),
        ("boat", "COUNT(*)", '{"name": "k"}', "no", {("parameters", "measure_parameter_json"), ("dimensions", "measure_dimension_json")}),
        ("boat", "COUNT(*)", parameter(type=""), '["tags"]', {("parameters", "measure_parameter_contract"), ("dimensions", "measure_dimension_column")}),
        ("boat", "COUNT(*)", parameter(column="owner"), "[7]", {("parameters", "measure_parameter_column"), ("dimensions", "measure_dimension_column")}),
        (None, "COUNT(*)", None, None, {("target_class", "required")}),
    ]
    frame = spark.createDataFrame([(f"m{i}", f"m{i}", None, None, *r[:4]) for i, r in enumerate(rows)], MEASURES).coalesce(1)
    got = {}
    for r in plan(store, {"Measure": frame}, Provenance("p", "1")).issues.collect():
        got.setdefault(r["input_row"] - 1, set()).add((r["field"], r["rule"]))
    assert got == {i: r[4] for i, r in enumerate(rows) if r[4]}


def test_measures_of_the_dictionary_are_seeded_once(spark, store):
    boats = spark.createDataFrame([("b1", "sloop", "8"), ("b2", "sloop", "10"), ("b3", None, "30")], "id string, kind string, length string")
    ingest(store, {"boat": boats}, Provenance("p", "1"), "2024-01-01T00:00:00")
    for _ in range(2):
        assert seed_measures(store, json.dumps(YARD), "2024-01-02T00:00:00") == {"insert": 1}
    assert len(store.commits()) == 2 and Knowledge(store).measure("mean length").first()["value"] == 16.0


def test_bounded_groups_say_whether_there_were_more(spark):
    rows = spark.range(30).selectExpr("id % 7 as k", "id as n")
    m = measures.Measure("m", "x", "SUM(n)", dimensions=("k",))
    for most, more in ((7, False), (6, True)):
        first, truncated = measures.evaluate_bounded(rows, m, by=("k",), most=most)
        assert [r["k"] for r in first.collect()] == list(range(most)) and truncated.first()["truncated"] is more


@pytest.mark.parametrize(
    "payload, unsafe",
    [
        ('{"a":1}', False), ('{"a":9007199254740991}', False), ('{"a":9007199254740992}', True), ('{"a":-9223372036854775808}', True), ('{"a":1e400}', True), ('{"a":[1,1E-400]}', True), ('{"a":0e-400}', False), ('{"a":0.000}', False),
        ('{"a":"1e400"}', False), ('{"a":"x\\"1e400"}', False), ('{"1e400":1.5}', False), ('{"a":12345678901234.567}', False), ('{"a":1e20}', False), ('{"a":"\\\\","b":1e400}', True), ("{}", False),
    ],
)
def test_numbers_of_payloads(spark, payload, unsafe):
    assert spark.createDataFrame([(payload,)], "payload string").select(unsafe_numbers(F.col("payload"))).first()[0] is unsafe


@pytest.mark.parametrize("number, safe", [("1", True), ("9007199254740991", True), ("9007199254740992", False), ("-9223372036854775808", False), ("1e400", False), ("1e-400", False), ("0.0", True), ("1e15", True)])
def test_numbers_of_dictionaries(number, safe):
    text = json.dumps(YARD).replace('"number"', '"number", "range": {"min": N}').replace("N}", number + "}")
    if safe:
        assert C.from_table_dictionary(text)["boat"].slot("length").minimum == float(number)
    else:
        with pytest.raises(ContractError) as e:
            C.from_table_dictionary(text)
        assert e.value.rule == "unsafe_json_number"


BASE = """
name: base
imports: [linkml:types, units]
slots:
  id: {identifier: true, range: uriorcurie}
classes:
  Thing: {abstract: true, slots: [id], annotations: {x.role: node}}
  Place: {is_a: Thing, attributes: {label: {required: true}, unit: {range: Unit}}}
"""
UNITS = "name: units\nenums:\n  Unit: {permissible_values: {m: {}, km: {description: thousand}}}\n"
TOP = "name: top\nimports: [base]\nclasses:\n  Road: {is_a: Thing, attributes: {ends: {range: Place, multivalued: true}}}\n"


def test_imports():
    texts = {"base": BASE, "units": UNITS}
    own = C.from_linkml(TOP, resolve=texts.__getitem__)
    assert set(own.classes) == {"Place", "Road"} and own["Road"].slot("ends").reference == "Place" and own["Place"].slot("unit").enum == ("m", "km")
    other = C.from_linkml(TOP, resolve=(texts | {"units": UNITS.replace("thousand", "1000")}).__getitem__)
    assert own.compatible(other) and own.build_digest() != other.build_digest()


@pytest.mark.parametrize(
    "texts, rule",
    [
        ({"base": BASE, "units": UNITS + "imports: [base]\n"}, "import_cycle"),
        ({"base": BASE, "units": UNITS + "slots: {id: {range: string}}\n"}, "unique_import_names"),
        ({"base": BASE.replace("{abstract: true", "{abstract: true, mixins: [Place]"), "units": UNITS}, "supported_linkml"),
        ({"base": BASE.replace("required: true", "any_of: [{range: string}]"), "units": UNITS}, "supported_linkml"),
        ({"base": BASE, "units": UNITS.replace("permissible_values", "reachable_from: {x: y}, permissible_values")}, "supported_linkml"),
        ({"base": BASE, "units": UNITS.replace("description: thousand", "is_a: m")}, "supported_linkml"),
        ({"base": BASE.replace("slots:", "types: {Own: {}}\nslots:", 1), "units": UNITS}, "supported_linkml"),
        ({"base": BASE.replace("label: {", "label: {ifabsent: string(x), "), "units": UNITS}, "supported_linkml"),
        ({"base": BASE.replace("{is_a: Thing,", "{is_a: Thing, unique_keys: {a: {}},"), "units": UNITS}, "supported_linkml"),
    ],
)
def test_schemas_that_are_refused(texts, rule):
    with pytest.raises(ContractError) as e:
        C.from_linkml(TOP, resolve=texts.__getitem__)
    assert e.value.rule == rule
    with pytest.raises(ContractError) as e:
        C.from_linkml(TOP)
    assert e.value.rule == "import_exists"


def test_contracts_are_read_by_what_they_are(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    boats = C.from_table_dictionary(json.dumps(YARD))
    assert C.read_contract(spark, put("yard.json", json.dumps(YARD))).compatible(boats)
    assert C.read_contract(spark, put("kept.contract.json", boats.to_json())) == boats
    put("base.yaml", BASE), put("units.yaml", UNITS)
    assert set(C.read_contract(spark, put("top.yaml", TOP)).classes) == {"Place", "Road"}
    for name, text, rule in (("yard.txt", "{}", "schema_extension"), ("odd.json", '{"name": "x"}', "schema_kind"), ("both.yaml", "tables: []\nclasses: {}\n", "schema_kind")):
        with pytest.raises(ContractError) as e:
            C.read_contract(spark, put(name, text))
        assert e.value.rule == rule


def test_public_dictionaries_tell_nothing_of_data():
    own = {"name": "x", "origin": "db", "tables": [{"name": "t", "origin": "o", "source": "s", "note": 1, "columns": [{"name": "id", "examples": ["a"], "range": {"min": 1}, "fields": [{"name": "in", "examples": [1], "type": "string"}]}]}]}
    assert C.public_dictionary(json.dumps(own)) == {"name": "x", "tables": [{"name": "t", "note": 1, "columns": [{"name": "id", "fields": [{"name": "in", "type": "string"}]}]}]}


def test_records_by_ids(spark, store):
    boats = spark.createDataFrame([(f"b{i}", "sloop", "8") for i in range(9)], "id string, kind string, length string")
    ingest(store, {"boat": boats}, Provenance("p", "1"), "2024-01-01T00:00:00")
    assert sorted(r["record_id"] for r in store.records("boat", ids=["b3", "b5", "none"]).collect()) == ["b3", "b5"]
    assert store.records("boat", ids=boats.selectExpr("id as record_id").filter("record_id < 'b2'")).count() == 2 and store.records("boat", ids=[]).count() == 0
