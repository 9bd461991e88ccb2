"""One Markdown file for each record: lists, round trip with review, odd ids."""

import inspect
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_store import LINKML
from tidemark.errors import LimitError
from tidemark.functions import percent_encoded
from tidemark.operators import files
from tidemark.plans.plan import Provenance, commit, ingest
from tidemark.sources import contract as C
from tidemark.sources.store import Store

PROOF = LINKML + "  Proof:\n    is_a: Thing\n    attributes: {statement_id: {}, source_id: {range: Source}, support_type: {}}\n    annotations: {x.role: evidence, x.id_policy: mint}\n"


@pytest.fixture
def store(spark, tmp_path):
    own = Store.open(spark, f"file://{tmp_path}/store", C.from_linkml(PROOF))
    sources = spark.createDataFrame([("s/1 ?=ü", "A & B", "10.1/x"), ("s2", None, None)], "id string, label string, doi string")
    claims = spark.createDataFrame([("c1", ["s/1 ?=ü", "s2"], "a", "0.5"), ("c2", ["s2"], "b", None)], "id string, about array<string>, kind string, score string")
    proofs = spark.createDataFrame([(f"e{i:03}", "c1", "s/1 ?=ü" if i % 2 else "s2", "supports") for i in range(120)], "id string, statement_id string, source_id string, support_type string")
    ingest(own, {"Source": sources, "Claim": claims, "Proof": proofs}, Provenance("p", "1"), "2024-01-01T00:00:00")
    return own


def test_published_tree(spark, store, tmp_path):
    path = f"file://{tmp_path}/tree"
    exported = files.publish(store, path)
    found = {p.parent.name: p.read_text() for p in Path(f"{tmp_path}/tree").glob("class=Claim/page=*/*.txt")}
    assert set(found) == {"page=c1", "page=c2"}
    page = found["page=c1"]
    assert "* about: [A & B](../../class=Source/page=s_2F1_20_3F_3D_C3_BC)\n* about: [s2](../../class=Source/page=s2)" in page
    assert page.count("* supports: ") == 100 and "* and 20 more" in page and "## Evidence" not in found["page=c2"]
    assert Path(f"{tmp_path}/tree/class=Source/page=s_2F1_20_3F_3D_C3_BC").is_dir() and not Path(f"{tmp_path}/tree.staged").exists()
    kinds = lambda: {(r["class"], r["record_id"]): r["kind"] for r in files.compare(store, path).collect() if r["class"] != "Proof"}
    assert set(kinds().values()) == {"unchanged"} and ("Source", "s/1 ?=ü") in kinds()
    assert files.tree_digest(files.edited(store, path)) == exported
    # an edited file is a change, and a second publication takes the place of the first
    file = next(Path(f"{tmp_path}/tree").glob("class=Source/page=s2/*.txt"))
    file.write_text(file.read_text().replace("class: Source\n", 'class: Source\nlabel: {"v":"New"}\n'))
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    assert kinds()["Source", "s2"] == "edited"
    assert commit(store, files.review(store, path, Provenance("r", "1")), "2024-01-02T00:00:00")["update"] == 1
    assert kinds()["Source", "s2"] == "converged"
    files.publish(store, path)
    assert set(kinds().values()) == {"unchanged"} and json.loads(store.heads().filter("record_id = 's2'").first()["payload"])["label"] == "New"
    with pytest.raises(LimitError):
        files.publish(store, path, limit=3)


def test_percent_encoding(spark):
    from urllib.parse import quote

    texts = ["a b", "ü/é?", "*~-._", "100%", "", "+&="]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(percent_encoded(F.col("t"))).collect()
    assert [r[0] for r in got] == [quote(t, safe="") for t in texts]


def test_a_publication_takes_all_records_in_several_tasks(spark, tmp_path):
    """The default had refused stores of more than 10,000 records, and small pages were all written by one task."""
    assert inspect.signature(files.publish).parameters["limit"].default is None
    pages = spark.range(40).selectExpr("concat('text ', id) as value", "'C' as class", "cast(id as string) as page")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        files.write_pages(pages, f"file://{tmp_path}/tree")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    written = list(Path(f"{tmp_path}/tree").glob("class=C/page=*/*.txt"))
    assert len(written) == 40 and len({p.name.split("-")[1] for p in written}) > 4
