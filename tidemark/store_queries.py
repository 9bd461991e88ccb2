"""Queries over stores that are written to while they run: boundaries, contracts that grow, commits side by side, reviews, forged and copied stores."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import RecordError, StalePlanError
from .operators import files
from .plans.plan import Plan, Provenance, commit, conflicts, ingest, plan
from .queries import CATALOG, CUSTOMER_TABLE, _new_sales_store, _sales_store, query
from .shared import shared_dir
from .sources import tables as t
from .sources.contract import from_linkml, from_table_dictionary
from .sources.store import Commit, Snapshot, Store


def _fresh(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"


def _customers(spark: SparkSession, sf: str, where: str = "true", **changed: Column) -> DataFrame:
    c = t.read(spark, sf, "customer").filter(where)
    own = {"id": t.key("customer", "c_custkey"), "name": F.col("c_name"), "segment": F.col("c_mktsegment"), "number": F.col("c_custkey").cast("string"), "nation": t.key("nation", "c_nationkey")}
    return c.select(*[v.alias(k) for k, v in (own | changed).items()])


def _outcome(call) -> str:
    """`read`, or the rule by which a read is refused; Spark's own error where a row is."""
    try:
        call()
    except RecordError as e:
        return e.rule
    except Exception as e:
        return "content_digest" if "content digest" in str(e) else type(e).__name__
    return "read"


@query(
    "select 'batch' as boundary, 'read' as outcome, (select count(*) from nation) + (select count(*) from customer) as n union all select 'time', 'read', (select count(*) from nation) + (select count(*) from customer)"
    " union all select 'before_all', 'read', 0 union all select 'latest', 'read', (select count(*) from nation) + (select count(*) from customer) + (select count(*) from customer where c_custkey % 3 = 0 and c_mktsegment <> 'MOVED')"
    " union all select x, 'history_boundary', 0 from (values ('unknown_batch'), ('unreadable_time'), ('time_after_pin'), ('batch_after_pin')) y(x)"
)
def store_boundaries(spark, sf):
    """What a history holds at each kind of boundary, and the boundaries that are refused."""
    store = _sales_store(spark, sf)
    first, second = store.commits()
    pinned = store.at(Snapshot(store.path, 1, first.batch_id, first.committed_at, first.schema_digest, first.chain))
    asked = {
        "batch": (store, first.batch_id), "time": (store, "2024-01-01T12:00:00Z"), "before_all": (store, "2023-12-31"), "latest": (store, None),
        "unknown_batch": (store, "batch-nope"), "unreadable_time": (store, "yesterday"), "time_after_pin": (pinned, "2099-01-01"), "batch_after_pin": (pinned, second.batch_id),
    }
    out = None
    for kind, (own, at) in asked.items():
        outcome = _outcome(lambda own=own, at=at: own.history(as_of=at))
        rows = own.history(as_of=at) if outcome == "read" else own.revisions().limit(0)
        row = rows.agg(F.lit(kind).alias("boundary"), F.lit(outcome).alias("outcome"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "select 'customer:' || c_custkey as record_id, x.n as revision_number, case when x.n = 1 then 'name,nation,number,segment' else 'balance,name,nation,number,segment' end as fields,"
    " case when x.n = 1 then 'name,nation,number,segment' else 'balance' end as changed_fields, c_mktsegment as segment, case when x.n = 2 then c_acctbal end as balance from customer, (values (1), (2)) x(n) where x.n = 1 or c_custkey % 2 = 0"
)
def store_schema_versions(spark, sf):
    """Revisions of two contracts, each read by its own: the second has a slot more, and one that is restricted."""
    grown = json.loads(json.dumps(CUSTOMER_TABLE))
    grown["tables"][1]["columns"] += [{"name": "balance", "type": "number"}, {"name": "phone", "type": "string", "display": "restricted"}]
    old = _new_sales_store_first(spark, sf)
    store = Store.open(spark, old.path, from_table_dictionary(json.dumps(grown)), evolve=True)
    ingest(store, {"customer": _customers(spark, sf, "c_custkey % 2 = 0", balance=F.col("c_acctbal").cast("string"), phone=F.lit("secret"))}, Provenance("sales", "grown"), "2024-02-01T00:00:00")
    rows = store.revised("customer")
    return rows.select("record_id", "revision_number", F.concat_ws(",", "fields").alias("fields"), F.concat_ws(",", "changed_fields").alias("changed_fields"), "segment", "balance")


def _new_sales_store_first(spark: SparkSession, sf: str) -> Store:
    """A new store with nations and customers in one batch."""
    store = Store.open(spark, _fresh(spark), from_table_dictionary(json.dumps(CUSTOMER_TABLE)))
    nations = t.read(spark, sf, "nation").select(t.key("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    ingest(store, {"nation": nations, "customer": _customers(spark, sf)}, Provenance("sales", "1"), "2024-01-01T00:00:00")
    return store


@query(
    "select c_mktsegment_new as segment, max(rev) as revision_number, count(*) as n from (select case when c_custkey % 2 = 0 then 'EVEN' else 'ODD' end as c_mktsegment_new, 2 as rev from customer) group by 1"
)
def store_commit_untouched(spark, sf):
    """A plan survives a batch that was committed after it was made and that touches other records."""
    store = _new_sales_store_first(spark, sf)
    mine = plan(store, {"customer": _customers(spark, sf, "c_custkey % 2 = 0", segment=F.lit("EVEN"))}, Provenance("one", "1"))
    ingest(store, {"customer": _customers(spark, sf, "c_custkey % 2 = 1", segment=F.lit("ODD"))}, Provenance("other", "1"), "2024-01-02T00:00:00")
    commit(store, mine, "2024-01-03T00:00:00")
    return store.records("customer").groupBy("segment").agg(F.max("revision_number").alias("revision_number"), F.count("*").alias("n"))


@query(
    "select 'record' as kind, 'touched' as outcome, count(*) as n from customer where c_custkey % 6 = 0 union all select 'identifier', 'touched', count(*) from supplier where s_suppkey % 5 = 0"
    " union all select 'origin', 'touched', count(*) from part where p_partkey % 4 = 0"
)
def store_commit_touched(spark, sf):
    """Plans that a later batch makes stale: by revisions of their records, and by identifiers and origin keys that it gave to other records."""
    store = _new_sales_store_first(spark, sf)
    mine = plan(store, {"customer": _customers(spark, sf, "c_custkey % 2 = 0", segment=F.lit("EVEN"))}, Provenance("one", "1"))
    ingest(store, {"customer": _customers(spark, sf, "c_custkey % 3 = 0", segment=F.lit("THIRD"))}, Provenance("other", "1"), "2024-01-02T00:00:00")
    found = [_touched(store, mine)]

    catalog = Store.open(spark, _fresh(spark), from_linkml(CATALOG))
    n, k = F.col("s_suppkey"), F.col("p_partkey")
    doi = F.concat(F.lit("10.5/s"), n).alias("doi")
    suppliers = lambda prefix, where: {"Supplier": t.read(spark, sf, "supplier").filter(where).select(F.concat(F.lit(prefix), n).alias("id"), F.col("s_name").alias("label"), doi)}
    mine = plan(catalog, suppliers("mine:", "true"), Provenance("one", "1"))
    ingest(catalog, suppliers("theirs:", "s_suppkey % 5 = 0"), Provenance("other", "1"), "2024-01-01T00:00:00")
    found.append(_touched(catalog, mine))

    items = Store.open(spark, _fresh(spark), from_linkml(CATALOG))
    parts = lambda prefix, where: {"Item": t.read(spark, sf, "part").filter(where).select(F.concat(F.lit(prefix), k).alias("id"), F.col("p_name").alias("label"), k.cast("string").alias(".origin_key"))}
    mine = plan(items, parts("mine:", "true"), Provenance("one", "1"))
    ingest(items, parts("theirs:", "p_partkey % 4 = 0"), Provenance("one", "2"), "2024-01-01T00:00:00")
    found.append(_touched(items, mine))
    return found[0].unionByName(found[1]).unionByName(found[2])


def _touched(store: Store, mine: Plan) -> DataFrame:
    """What made a plan stale, counted, with the rule by which its commit was refused."""
    found = conflicts(store, mine).groupBy("kind").agg(F.count("*").alias("n")).collect()
    try:
        commit(store, mine, "2024-01-03T00:00:00")
        outcome = "committed"
    except StalePlanError as e:
        outcome = e.rule
    return store.spark.createDataFrame([(r["kind"], outcome, r["n"]) for r in found], "kind string, outcome string, n long")


@query(
    "with c as (select *, row_number() over (order by c_custkey) as input_row from customer) select 'customer' as class, input_row, 'customer:' || c_custkey as record_id, x.field, x.rule,"
    " 'customer.' || x.field || ' ' || x.says as message, x.kind as condition_class from c, (values ('name', 'required', 'needs a value', 'validation_error'), ('number', 'type_integer', 'breaks type_integer', 'validation_error'),"
    " ('nation', 'reference_exists', 'refers to no record', 'reference_error')) x(field, rule, says, kind)"
    " where (x.rule = 'required' and c_custkey % 5 = 1) or (x.rule = 'type_integer' and c_custkey % 7 = 2) or (x.rule = 'reference_exists' and c_nationkey = 3)"
)
def store_issue_rows(spark, sf):
    """Issues with the row of the input that they are about, gapless over its partitions, a message and the kind of error."""
    n = F.col("c_custkey")
    bad = _customers(
        spark, sf, name=F.when(n % 5 == 1, F.lit(" ")).otherwise(F.col("c_name")), number=F.when(n % 7 == 2, F.lit("1.5")).otherwise(n.cast("string")),
        nation=F.when(F.col("c_nationkey") == 3, F.lit("nation:none")).otherwise(t.key("nation", "c_nationkey")),
    )
    ordered = bad.repartitionByRange(8, F.split("id", ":")[1].cast("long")).sortWithinPartitions(F.split("id", ":")[1].cast("long"))
    return plan(_sales_store(spark, sf), {"customer": ordered}, Provenance("sales", "rows")).issues


@query(
    "with c as (select c_custkey k, 'customer' as class from customer), x as (select class, case when k % 11 = 1 then 'removed' when k % 11 = 2 then 'edited' when k % 11 = 3 then 'behind' when k % 11 = 4 then 'stale_base'"
    " when k % 11 = 5 then 'repeated' else 'unchanged' end as kind from c union all select 'nation', 'unchanged' from nation union all select 'customer', 'added' from c where k % 11 = 6 union all select 'customer', 'new_in_store' from c where k % 11 = 7)"
    " select class, kind, count(*) as n from x group by 1, 2"
)
def store_review(spark, sf):
    """Every page of an edited tree against a store that moved on since it was made."""
    store = _new_sales_store_first(spark, sf)
    tree, work = _fresh(spark), _fresh(spark)
    files.sync(store, tree)
    k = F.get(F.split("record_id", ":"), F.lit(1)).cast("long") % 11
    of = lambda *kinds: (F.col("class") == "customer") & k.isin(*kinds)
    read = spark.read.schema("record_id string, content string, class string").json(tree)
    changed = read.filter(~of(1)).withColumn("content", F.when(of(2, 4), F.regexp_replace("content", "(?m)^segment: .*$", 'segment: {"v":"EDITED"}')).otherwise(F.col("content")))
    copies = read.filter(of(5))
    added = read.filter(of(6)).select(F.concat("record_id", F.lit(":new")).alias("record_id"), F.regexp_replace("content", "(?m)^(base|page|id): .*\n", "").alias("content"), "class")
    changed.unionByName(copies).unionByName(added).write.partitionBy("class").json(work)
    moved = _customers(spark, sf, "c_custkey % 11 in (3, 4)", segment=F.lit("MOVED"))
    new = _customers(spark, sf, "c_custkey % 11 = 7", id=F.concat(t.key("customer", "c_custkey"), F.lit(":later")))
    ingest(store, {"customer": moved.unionByName(new)}, Provenance("sales", "2"), "2024-01-02T00:00:00")
    return files.compare(store, work).groupBy("class", "kind").agg(F.count("*").alias("n"))


@query(
    "select 'audit' as part, 'revision_digest_mismatch' as outcome, count(*) as n from customer where c_custkey % 4 = 0 union all select x, 'content_digest', 0 from (values ('records'), ('get'), ('history'), ('revised')) y(x)"
    " union all select 'other_class', 'read', count(*) from nation"
)
def store_forged(spark, sf):
    """Payloads that don't have their digests: the audit names them, and every read of them stops; other classes can be read."""
    store = _new_sales_store_first(spark, sf)
    kept = store.revisions().filter((F.col("class") == "customer") & (F.split("record_id", ":")[1].cast("long") % 4 == 0))
    here = {"batch_id": F.lit("batch-forged"), "commit_order": F.lit(2)}
    forged = kept.withColumns(here | {"payload": F.regexp_replace("payload", "Customer#", "Someone#"), "operation": F.lit("update"), "prior_revision_id": F.col("revision_id"), "revision_number": F.lit(2), "revision_id": F.concat("record_id", F.lit("#2"))})
    seen = forged.select("class", "record_id", "batch_id", "commit_order", F.lit("update").alias("disposition"), "revision_id", F.lit(None).cast("string").alias("origin_key"))
    last = store.commits()[-1]
    none = [store._table(n).limit(0) for n in ("identifiers", "origins")]
    store.publish(Commit(2, "batch-forged", "forger", "1", "", last.schema_digest, "2024-01-02T00:00:00"), last.chain, forged, seen, *none)
    audit = store.audit().groupBy(F.col("issue").alias("outcome")).agg(F.count("*").alias("n")).select(F.lit("audit").alias("part"), "outcome", "n")
    some = kept.agg(F.min("record_id")).first()[0]
    reads = {
        "records": lambda: store.records("customer").agg(F.max("name")).collect(), "get": lambda: store.get(some), "history": lambda: store.history(some).collect(),
        "revised": lambda: store.revised("customer").agg(F.max("name")).collect(),
    }
    refused = spark.createDataFrame([(k, _outcome(f), 0) for k, f in reads.items()], "part string, outcome string, n long")
    whole = store.records("nation").agg(F.lit("other_class").alias("part"), F.lit("read").alias("outcome"), F.count("name").alias("n"))
    return audit.unionByName(refused).unionByName(whole)


@query(
    "select 'copy' as store, 'read' as outcome, count(*) as n from customer union all select 'edited_log', 'snapshot_digest', 0 union all select 'other_store', 'boundary', 0 union all select 'without_digest', 'store_mismatch', 0"
)
def store_portable_snapshot(spark, sf):
    """A snapshot holds for a copy of its store, and not for one whose log was edited."""
    store = _new_sales_store(spark, sf)
    first = store.commits()[0]
    kept = Snapshot(**json.loads(Snapshot(store.path, 1, first.batch_id, first.committed_at, first.schema_digest, first.chain).to_json()))
    copies = [_copied(store) for _ in range(2)]
    marker = f"commits/{1:012d}.json"
    text = json.loads(copies[1].files.text(marker))
    copies[1].files.remove(marker)
    copies[1].files.create(marker, json.dumps(text | {"producer": "someone else"}))
    rows = copies[0].at(kept).records("customer").filter(F.col("segment").isNotNull()).agg(F.lit("copy").alias("store"), F.lit("read").alias("outcome"), F.count("*").alias("n"))
    other = _sales_store(spark, sf)
    asked = {"edited_log": (copies[1], kept), "other_store": (other, replace(kept, batch_id="batch-other")), "without_digest": (copies[0], replace(kept, digest=""))}
    refused = [(k, _outcome(lambda own=own, at=at: own.at(at)), 0) for k, (own, at) in asked.items()]
    return rows.unionByName(spark.createDataFrame(refused, "store string, outcome string, n long"))


def _copied(store: Store) -> Store:
    path = _fresh(store.spark)
    own = Store(store.spark, path, store.contract)
    util = store.spark._jvm.org.apache.hadoop.fs.FileUtil
    util.copy(store.files.fs, store.files.path(""), own.files.fs, own.files.path(""), False, store.spark._jsc.hadoopConfiguration())
    return own


@query(
    "with x as (select c_custkey k, 'customer' as class, '* nation: [' || n_name || '](../../class=nation/page=nation_3A' || n_nationkey || ')' as line from customer join nation on c_nationkey = n_nationkey"
    " union all select null, 'nation', '' from nation) select class, line, case when k % 10 = 1 then 'edited' else 'unchanged' end as kind, count(*) as n from x where k is null or k % 10 <> 2 group by 1, 2, 3"
    " union all select 'customer', '', 'removed', count(*) from customer where c_custkey % 10 = 2"
)
def store_markdown(spark, sf):
    """A tree of one file for each record, with what each record refers to, read back after some files were edited and some taken out."""
    store = _new_sales_store_first(spark, sf)
    tree, work = _fresh(spark), _fresh(spark)
    files.publish(store, tree)
    rows = files._tree(store, tree)
    k = F.get(F.split("record_id", ":"), F.lit(1)).cast("long") % 10
    customer = F.col("class") == "customer"
    content = F.when(customer & (k == 1), F.regexp_replace("content", "(?m)^name: .*$", 'name: {"v":"Somebody"}')).otherwise(F.col("content"))
    kept = rows.filter(~customer | (k != 2)).select(content.alias("value"), "class", F.regexp_replace("record_id", ":", "_3A").alias("page"))
    files.write_pages(kept, work)
    lines = files.edited(store, work).select("class", "record_id", F.regexp_extract("content", r"(?m)^(\* nation: .*)$", 1).alias("line"))
    return files.compare(store, work).join(lines, ["class", "record_id"], "left").groupBy("class", F.coalesce("line", F.lit("")).alias("line"), "kind").agg(F.count("*").alias("n"))


@query(
    "select x.class, x.id, x.label, x.matched from (select 'Customer' as class, 'customer:' || c_custkey as id, c_name as label, case when contains(lower(c_name), '1') and contains(lower(c_mktsegment), '1') then 'label,segment' else 'label' end as matched"
    " from customer where contains(lower(c_name), '00001') union all select 'Order', 'order:' || o_orderkey, o_orderpriority, 'statement_text' from orders where contains(lower(o_orderpriority), '00001')"
    " union all select 'Document', 'doc:' || doc_id, any_value(source), 'title' from documents where contains(lower(source), '00001') group by doc_id) x"
)
def store_find_all(spark, sf):
    """Records of all classes whose label or searched fields hold a text, with the fields that do."""
    from .queries import _knowledge

    rows = _knowledge(spark, sf).find_rows("00001").filter(F.col("class").isin("Customer", "Order", "Document"))
    return rows.select("class", "id", "label", F.concat_ws(",", "matched_fields").alias("matched"))
