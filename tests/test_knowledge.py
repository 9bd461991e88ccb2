"""Reads by role over a small store of orchard records: claims, evidence, mentions, graph and caps, measures, dispatcher."""

import pytest

from tidemark.errors import LimitError, MeasureError, RecordError, ReferenceError_, SnapshotError
from tidemark.plans.plan import Provenance, ingest
from tidemark.sources.contract import from_linkml
from tidemark.sources.knowledge import Knowledge, measured
from tidemark.sources.store import Store

ORCHARD = """
name: orchard
default_range: string
slots:
  id: {identifier: true, range: uriorcurie}
classes:
  Base: {abstract: true, slots: [id], annotations: {x.id_policy: require}}
  Node: {abstract: true, is_a: Base, annotations: {x.role: node}}
  Tree: {is_a: Node, attributes: {label: {required: true}, rows: {range: integer}, tag: {annotations: {x.external_identifier: tag}}}}
  Book: {is_a: Base, attributes: {title: {}, uri: {range: uri}}, annotations: {x.role: source}}
  Remark:
    is_a: Base
    attributes: {statement_text: {required: true}, primary_subject: {range: Node}, about: {range: Node, multivalued: true}, status: {}, superseded_by: {range: Remark}}
    annotations: {x.role: statement}
  Fact:
    is_a: Base
    attributes: {subject: {range: Node, required: true}, predicate: {required: true}, object_entity: {range: Node}, object_value: {}, derived_from_statement: {range: Remark}, status: {}}
    annotations: {x.role: statement}
  Proof: {is_a: Base, attributes: {statement_id: {required: true}, source_id: {range: Book, required: true}, support_type: {required: true}}, annotations: {x.role: evidence}}
  Spotted: {is_a: Base, attributes: {source_id: {range: Book}, surface_form: {}, entity_id: {range: Node}}, annotations: {x.role: mention}}
"""


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    store = Store.open(spark, f"file://{tmp_path_factory.mktemp('orchard')}/s", measured(from_linkml(ORCHARD)))
    make = spark.createDataFrame
    trees = make([(f"t{i}", f"tree {i}", str(i), "T-7" if i == 7 else None) for i in range(12)], "id string, label string, rows string, tag string")
    records = {
        "Tree": trees,
        "Book": make([("b1", "Pomology", "http://x.org/p"), ("b2", None, None)], "id string, title string, uri string"),
        "Remark": make([("r1", "Pears like t0", "t0", ["t1", "t2"], None, None), ("r2", "old", "t0", None, "superseded", "r1")], "id string, statement_text string, primary_subject string, about array<string>, status string, superseded_by string"),
        "Fact": make([("f1", "t0", "near", "t3", None, "r1"), ("f2", "t0", "yield", None, "12", None), *[(f"g{i:02}", "t4", "feeds", f"t{i}", None, None) for i in range(5, 12)]], "id string, subject string, predicate string, object_entity string, object_value string, derived_from_statement string"),
        "Proof": make([("p1", "r1", "b1", "supports"), ("p2", "f1", "b2", "contradicts")], "id string, statement_id string, source_id string, support_type string"),
        "Spotted": make([("m1", "b1", "pear", "t0"), ("m2", "b1", "plum", None)], "id string, source_id string, surface_form string, entity_id string"),
        "Measure": make([("q1", "rows", "Tree", "SUM(rows) / COUNT(*)", '[{"name": "which", "type": "string", "description": "which label", "column": "label"}]', '["label"]')], "id string, name string, target_class string, expr string, parameters string, dimensions string"),
    }
    ingest(store, records, Provenance("orchard", "1"), "2024-01-01T00:00:00")
    return Knowledge(store)


def test_edge_kinds(known):
    got = {(r["edge_class"], r["subject"], r["predicate"], r["object"], r["layer"]) for r in known.edges().collect() if not r["edge_id"].startswith("g")}
    assert got == {
        ("semantic", "t0", "near", "t3", "semantic"), ("semantic_derivation", "f1", "derived_from_statement", "r1", "provenance"), ("primary_subject", "r1", "primary_subject", "t0", "provenance"),
        ("primary_subject", "r2", "primary_subject", "t0", "provenance"), ("about", "r1", "about", "t1", "provenance"), ("about", "r1", "about", "t2", "provenance"), ("superseded_by", "r2", "superseded_by", "r1", "provenance"),
        ("statement_evidence", "r1", "evidence", "p1", "provenance"), ("statement_evidence", "f1", "evidence", "p2", "provenance"), ("evidence_source", "p1", "source_id", "b1", "provenance"),
        ("evidence_source", "p2", "source_id", "b2", "provenance"), ("mention_entity", "m1", "entity_id", "t0", "provenance"),
    }
    assert {r["layer"] for r in known.edges("semantic").collect()} == {"semantic"} and known.edges("provenance").count() == 11


def test_graph_reads_and_caps(known):
    out = known.traverse("r1", ["primary_subject", "near"])
    assert [n["id"] for n in out.nodes] == ["r1", "t0", "t3"] and len(out.edges) == 2 and not out.truncated
    near = known.neighbors("t4", "feeds", "out", projection="semantic", max_nodes=4)
    assert [n["id"] for n in near.nodes] == ["t10", "t11", "t4", "t5"] and near.truncated and len(near.edges) == 3
    few = known.neighbors("t4", max_edges=2)
    assert few.truncated and [e["edge_id"] for e in few.edges] == ["g05", "g06"]
    with pytest.raises(LimitError):
        known.neighbors("t4", hops=3)
    with pytest.raises(ReferenceError_):
        known.neighbors("nobody")


def test_get_claims_evidence_and_mentions(known):
    got = known.get("t0")
    assert [r["record_id"] for r in got["related"]["claims"]] == ["f1", "f2", "r1"] and [r["record_id"] for r in got["related"]["evidence"]] == ["p1", "p2"]
    assert [r["record_id"] for r in known.get("b1", ("evidence",))["related"]["evidence"]] == ["p1"] and known.get("p1")["related"]["evidence"] == []
    assert [r["record_id"] for r in known.claims("t0", include_superseded=True).rows] == ["f1", "f2", "r1", "r2"] and known.claims("t0", limit=1).truncated
    assert known.evidence(statement_id="r1").rows[0]["source_title"] == "Pomology"
    assert [r["record_id"] for r in known.unresolved().rows] == ["m2"]
    for bad in (lambda: known.evidence(), lambda: known.evidence("r1", support_type="likes"), lambda: known.get("t0", ("sources",))):
        with pytest.raises(RecordError):
            bad()


def test_dispatcher_identifiers_and_views(known):
    assert [r["record_id"] for r in known.query("lookup", {"namespace": "tag", "value": " T-7 "}).rows] == ["t7"]
    assert [r["normalized"] for r in known.query("identifiers", {"id": "t7"}).rows] == ["T-7"]
    assert known.query("integrity").rows == [] and len(known.query("unresolved", limit=5).rows) == 1
    with pytest.raises(RecordError):
        known.query("claims", {"id": "t0", "color": "red"})
    with pytest.raises(RecordError):
        known.query("drop")
    view = Knowledge(known.store.at(known.store.snapshot()))
    assert view.traverse("r1", ["primary_subject"]).edges == known.traverse("r1", ["primary_subject"]).edges
    with pytest.raises(SnapshotError):
        view.query("integrity")


def test_measures_of_a_store(known):
    assert [m["name"] for m in known.measures().rows] == ["rows"]
    assert known.measure("rows").first()["value"] == 5.5 and known.measure("rows", {"which": "tree 3"}).first()["value"] == 3.0
    assert known.measure("rows", by=("label",)).first()["label"] == "tree 0"
    with pytest.raises(MeasureError):
        known.measure("none")




def test_capped_claims_of_a_record_are_of_all_its_classes(known):
    """A class with more claims than the cap leaves room for the others; the answer is in order of class and id."""
    got = known.get("t0", ("claims",), {"claims": 2})
    assert [(r["class"], r["record_id"]) for r in got["related"]["claims"]] == [("Fact", "f1"), ("Remark", "r1")] and got["truncated"]["claims"]
