"""Proposing and accepting changes: candidates become a plan of frames with issues, a valid plan becomes one batch.

The input frames are evaluated once: `plan` writes the staged candidates below the store's path and goes on from there, so a
frame that isn't deterministic can't commit other content than its digest. Candidates without an id meet their records by
registered identifiers and by their producer's origin keys; candidates that share such a key are one record.

A plan is bound to what it touches, not to the whole store: a commit looks into the batches after the plan's base for revisions of its
records, and for identifiers and origin keys of its candidates that were given to other records. Only these make it stale.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidPlanError, ReplayConflictError, StalePlanError
from ..functions import iso_micros, normalize_identifier, record_id
from ..operators import identity, measures, validation
from ..sources.contract import MEASURE, STRICT, RecordClass, Slot, measure_definitions
from ..sources.store import Commit, Store, columns_of, content_digest, union

#: Column of a candidate frame with the producer's own key of a record; else it comes from the class's origin slots.
ORIGIN = ".origin_key"
ISSUE = ["class", "candidate", "record_id", "field", "rule"]
#: Rules whose breach is a matter of identity or of references; all others are of validation.
IDENTITY_RULES = ("required_internal_id", "unique_batch_id", "class_compatible_id", "consistent_exact_identity", "internal_external_identity_agreement", "unique_origin", "origin_identity_agreement", "deterministic_key_complete")
REFERENCE_RULES = ("reference_exists", "reference_class", "no_self_supersession")
#: What a rule asks for, where its name alone doesn't tell.
ASKS = {
    "required": "needs a value", "known_field": "isn't a field of the class", "enum_membership": "isn't one of the permitted values", "reference_exists": "refers to no record", "reference_class": "refers to a record of a class that the field doesn't take",
    "required_internal_id": "needs an id", "unique_batch_id": "stands in the batch more than once", "class_compatible_id": "belongs to a record of another class", "consistent_exact_identity": "stands for more than one record",
    "internal_external_identity_agreement": "contradicts an identifier of the candidate", "unique_origin": "stands for more than one record", "origin_identity_agreement": "contradicts the candidate's other identity", "deterministic_key_complete": "needs all parts of its key",
    "no_self_supersession": "refers to the record itself", "valid_time_order": "ends before it begins", "exactly_one_semantic_object": "needs one of the two objects", "minimum_value": "is below the least value", "maximum_value": "is above the greatest value",
}
OWN_SLOTS = ("id", "created_at", "updated_at")
#: Batches of more candidates are dealt out by key in every join.
DEALT = 1 << 15


@dataclass(frozen=True)
class Provenance:
    producer: str
    idempotency_key: str
    version: str = ""
    run_id: str = ""
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    """What a commit would do: changes by record, issues, and digests that bind it to its input and to the store."""

    provenance: Provenance
    base_order: int
    changes: DataFrame  # class, record_id, action, payload, content_digest, prior...
    issues: DataFrame
    identifiers: DataFrame
    origins: DataFrame
    input_digest: str
    plan_digest: str
    valid: bool
    folder: str


def _typed(slot: Slot) -> Column:
    value = F.col(slot.name)
    if slot.multivalued:
        return F.transform(value, lambda x: STRICT[slot.type](x.cast("string")))
    return F.when(~validation.missing(value), STRICT[slot.type](value.cast("string")))


def _rest(own: RecordClass) -> Column:
    """Canonical JSON of a record but for its id: slots in the contract's order, nulls kept, exact numbers and times as text."""

    def shown(slot):
        if slot.multivalued:
            return _typed(slot)
        if slot.type in ("integer", "decimal"):
            return _typed(slot).cast("string")
        return iso_micros(_typed(slot)) if slot.type == "datetime" else _typed(slot)

    columns = [shown(s).alias(s.name) for s in own.slots if s.name not in OWN_SLOTS]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("{}")


def payload(rid: Column, rest: Column) -> Column:
    """The JSON of a record: its id before the rest."""
    first = F.to_json(F.struct(rid.alias("id")), {"ignoreNullFields": "false"})
    return F.when(rest == "{}", first).otherwise(F.concat(F.regexp_replace(first, r"\}$", ","), F.substring(rest, 2, 1 << 30)))


def _rules(own: RecordClass, unknown: list[str]) -> list[tuple[str, str, Column]]:
    known = {s.name for s in own.slots}
    rules = [(s.name, rule, broken) for s in own.slots if s.name != "id" for rule, broken in validation.rules_for(s)]
    rules += [(c, "known_field", F.lit(True)) for c in unknown]
    if {"valid_from", "valid_to"} <= known:
        rules.append(("valid_to", "valid_time_order", STRICT["datetime"](F.col("valid_from").cast("string")) > STRICT["datetime"](F.col("valid_to").cast("string"))))
    if {"object_entity", "object_value"} <= known:
        rules.append(("object_value", "exactly_one_semantic_object", validation.exactly_one("object_entity", "object_value")))
    return rules


def _staged(own: RecordClass, frame: DataFrame) -> DataFrame:
    """Candidates of a class in the form that all classes share."""
    known = {s.name for s in own.slots}
    unknown = [c for c in frame.columns if c not in known and c != ORIGIN]
    for s in own.slots:
        if s.name not in frame.columns:
            frame = frame.withColumn(s.name, F.lit(None).cast("array<string>" if s.multivalued else "string"))
    text = lambda name: F.when(~validation.missing(F.col(f"`{name}`")), F.trim(F.col(f"`{name}`").cast("string")))
    keys = F.array(*[text(c) for c in own.origin_slots]).cast("array<string>")
    complete = F.size(keys) > 0 if own.origin_slots else F.lit(False)
    derived = F.when(complete & ~F.exists(keys, lambda x: x.isNull()), F.concat(F.lit("origin-v1:"), F.sha2(F.to_json(keys), 256)))
    ids = [F.struct(F.lit(s.namespace).alias("namespace"), F.lit(s.name).alias("field"), normalize_identifier(F.lit(s.namespace), F.col(s.name).cast("string")).alias("normalized")) for s in own.slots if s.namespace]
    targets = lambda s: F.transform(F.col(s.name) if s.multivalued else F.array(text(s.name)), lambda x: F.struct(F.lit(s.name).alias("field"), F.trim(x).alias("target")))
    refs = [targets(s) for s in own.slots if s.reference]
    broken = [F.when(F.coalesce(b, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"))) for f, r, b in _rules(own, unknown)]
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    return frame.select(
        F.lit(own.name).alias("class"),
        F.lit(own.id_policy).alias("policy"),
        text("id").alias("supplied"),
        (F.coalesce(text(ORIGIN), derived) if ORIGIN in frame.columns else derived).alias("origin_key"),
        F.when(~F.exists(keys, lambda x: x.isNull()) & complete, keys).alias("keys"),
        F.filter(F.array(*ids), lambda x: x["normalized"].isNotNull()).alias("ids") if ids else none("namespace:string,field:string,normalized:string").alias("ids"),
        F.filter(F.flatten(F.array(*[F.coalesce(r, none("field:string,target:string")) for r in refs])), lambda x: x["target"].isNotNull()).alias("refs") if refs else none("field:string,target:string").alias("refs"),
        _rest(own).alias("rest"),
        F.array_compact(F.array(*broken)).alias("broken") if broken else none("field:string,rule:string").alias("broken"),
    )


def dealt(staged: DataFrame) -> DataFrame:
    """staged, never broadcast where it has many rows: its files are compressed, so by their size Spark takes it for a small table."""
    return staged.hint("merge") if staged.count() > DEALT else staged


def resolve(store: Store, staged: DataFrame, producer: str) -> DataFrame:
    """candidate, record_id, reason and odd (field and rule of each issue of identity) for every candidate.

    What is known of a candidate: its supplied id, the records of its identifiers and of its origin key. Candidates that
    share an identifier or an origin key are one component, and so are their known ids: one is taken, several are an issue, none is left to the class's policy.
    """
    supplied = staged.filter("supplied is not null").select("candidate", F.col("supplied").alias("known_id"), F.lit("id").alias("how"))
    ids = staged.select("candidate", "class", F.explode("ids").alias("x")).select("candidate", "class", "x.namespace", "x.field", "x.normalized")
    by_identifier = ids.join(store.identifiers().select("class", "namespace", "normalized", F.col("record_id").alias("known_id")), ["class", "namespace", "normalized"])
    origins = staged.filter("origin_key is not null").select("candidate", "class", "origin_key")
    of_producer = store.origins().filter(F.col("producer") == producer).select("class", "origin_key", F.col("record_id").alias("known_id"))
    by_origin = origins.join(of_producer, ["class", "origin_key"]).select("candidate", "known_id", F.lit("origin").alias("how"))
    known = union([supplied, by_identifier.select("candidate", "known_id", F.lit("identifier").alias("how")), by_origin]).distinct()
    per = known.groupBy("candidate").agg(
        *[F.count_distinct(F.when(F.col("how") == h, F.col("known_id"))).alias(f"n_{h}") for h in ("id", "identifier", "origin")],
        *[F.min(F.when(F.col("how") == h, F.col("known_id"))).alias(f"a_{h}") for h in ("id", "identifier", "origin")],
        F.count_distinct(F.when(F.col("how") != "origin", F.col("known_id"))).alias("n_exact"),
        F.min(F.when(F.col("how") != "origin", F.col("known_id"))).alias("a_exact"),
    )
    keys = ids.select("candidate", F.concat_ws("\x1f", F.lit("i"), "class", "namespace", "normalized").alias("key"))
    keys = keys.unionByName(origins.select("candidate", F.concat_ws("\x1f", F.lit("o"), "class", "origin_key").alias("key"))).distinct()
    shared = keys.join(keys.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi")
    own = staged.select("candidate", "class", "policy", "keys", "origin_key", "rest")
    if shared.isEmpty():
        own = own.withColumn("component", F.col("candidate"))
    else:
        own = own.join(identity.components(shared), "candidate", "left").withColumn("component", F.coalesce("component", "candidate"))
    keyed = own.join(keys.filter("key like 'i%'").groupBy("candidate").agg(F.min("key").alias("key")), "candidate", "left")
    found = own.select("candidate", "component").join(known, "candidate").groupBy("component").agg(F.count_distinct("known_id").alias("n"), F.min("known_id").alias("known_id"), F.min("how").alias("how"))
    # the candidate after which a component of new records is named
    named = keyed.groupBy("component").agg(F.min("key").alias("least_key"), F.min(F.struct("candidate", "keys", "origin_key", "rest")).alias("a"))
    out = own.select("candidate", "class", "policy", "keys", "component").join(named, "component").join(found, "component", "left")
    minted = record_id(F.col("class"), F.lit("mint"), F.lit(producer), F.coalesce("a.origin_key", "a.rest"))
    fresh = F.when(F.col("policy") == "deterministic", F.when(F.col("a.keys").isNotNull(), record_id(F.col("class"), F.lit("keys"), F.to_json("a.keys"))))
    fresh = fresh.when(F.col("policy") != "require", F.when(F.col("least_key").isNotNull(), record_id(F.col("class"), F.lit("exact"), F.col("least_key"))).otherwise(minted))
    one = F.col("n") == 1
    reason = F.when(one, F.col("how")).when(F.col("policy") == "deterministic", "deterministic_key").when(F.col("least_key").isNotNull(), "exact_identifier_mint").otherwise("mint")
    resolved = out.select("candidate", F.when(one, F.col("known_id")).when(F.col("n").isNull(), fresh).alias("record_id"), reason.alias("reason"), "n", "policy", F.col("a.keys").alias("a_keys"))
    rules = [
        ("id", "internal_external_identity_agreement", (F.col("n_id") == 1) & (F.col("n_identifier") > 0) & ((F.col("n_identifier") > 1) | (F.col("a_identifier") != F.col("a_id")))),
        (ORIGIN, "unique_origin", F.col("n_origin") > 1),
        (ORIGIN, "origin_identity_agreement", (F.col("n_exact") == 1) & (F.col("n_origin") == 1) & (F.col("a_origin") != F.col("a_exact"))),
        ("id", "consistent_exact_identity", (F.col("n") > 1) | (F.col("n_identifier") > 1)),
        ("id", "required_internal_id", F.col("n").isNull() & (F.col("policy") == "require")),
        ("id", "deterministic_key_complete", F.col("n").isNull() & (F.col("policy") == "deterministic") & F.col("a_keys").isNull()),
    ]
    judged = resolved.join(per, "candidate", "left")
    odd = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"))) for f, r, b in rules]))
    return judged.select("candidate", "record_id", "reason", odd.alias("odd"))


def row_starts(staged: DataFrame) -> DataFrame:
    """class, part and start: what turns a candidate's number into the row of its class's frame, from 1, in the order of the frame.

    Rows of a partition are numbered as they come; only the counts of the partitions are added up, so no task sees all rows.
    """
    sizes = staged.groupBy("class", F.shiftright("candidate", 33).alias("part")).agg(F.count("*").alias("n"), F.min("candidate").alias("first"))
    before = F.sum("n").over(W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return sizes.select("class", "part", (before - F.col("first") + 1).alias("start"))


def _described(issues: DataFrame, staged: DataFrame) -> DataFrame:
    """issues with the row of the input, a message and the kind of error, in order: class, input row (none last), field, rule, message."""
    asks = F.create_map(*[F.lit(x) for kv in ASKS.items() for x in kv])
    message = F.concat("class", F.lit("."), "field", F.lit(" "), F.coalesce(F.element_at(asks, F.col("rule")), F.concat(F.lit("breaks "), "rule")))
    kind = F.when(F.col("rule").isin(*IDENTITY_RULES), "identity_error").when(F.col("rule").isin(*REFERENCE_RULES), "reference_error").otherwise("validation_error")
    # one row of three numbers for each task of the input
    rows = issues.withColumn("part", F.shiftright("candidate", 33)).join(F.broadcast(row_starts(staged)), ["class", "part"], "left")
    rows = rows.select("class", (F.col("start") + F.col("candidate")).alias("input_row"), "record_id", "field", "rule", message.alias("message"), kind.alias("condition_class"))
    return rows.orderBy("class", F.asc_nulls_last("input_row"), "field", "rule", "message")


def plan(store: Store, records: dict[str, DataFrame], provenance: Provenance) -> Plan:
    """A plan for candidate frames by class. Bad data becomes issues, never an error."""
    spark, folder = store.spark, f"{store.path}/staging/{uuid.uuid4().hex}"
    base = store.snapshot().commit_order
    known = Store(spark, store.path, store.contract, base)  # what comes meanwhile is for the commit to see
    staged = union([_staged(store.contract[name], frame) for name, frame in records.items()]).withColumn("candidate", F.monotonically_increasing_id())
    own = [store.contract[n] for n in records]
    simple = all(c.id_policy == "require" and not c.origin_slots and not any(s.namespace for s in c.slots) for c in own) and not any(ORIGIN in f.columns for f in records.values())
    if simple:  # nothing but supplied ids to go by: the changes are the only staged rows
        made = staged.withColumn("record_id", F.col("supplied")).withColumn("reason", F.lit("id"))
    else:
        staged.write.option("compression", "zstd").parquet(f"{folder}/staged")
        staged = dealt(spark.read.parquet(f"{folder}/staged"))
        made = staged.join(resolve(known, staged, provenance.producer), "candidate")
    if base:
        heads = known.heads().select("record_id", F.col("class").alias("head_class"), "revision_number", F.col("revision_id").alias("prior_revision_id"), F.col("content_digest").alias("head_digest"), "created_at")
        made = made.join(heads, "record_id", "left")
    else:  # a store without batches has no heads
        made = made.withColumns({c: F.lit(None).cast(t) for c, t in (("head_class", "string"), ("revision_number", "int"), ("prior_revision_id", "string"), ("head_digest", "string"), ("created_at", "string"))})
    # payloads are made after the rows are dealt by record
    made = made.withColumn("payload", payload(F.col("record_id"), F.col("rest"))).withColumn("content_digest", content_digest())
    action = F.when(F.col("head_digest").isNull(), "insert").when(F.col("head_digest") == F.col("content_digest"), "match").otherwise("update")
    made.withColumn("action", action).write.option("compression", "zstd").parquet(f"{folder}/changes")
    changes = spark.read.parquet(f"{folder}/changes")
    if simple:
        staged = changes

    at_row = ["class", "candidate", "record_id"]
    of = lambda odd: changes.select(*at_row, F.explode(odd).alias("x")).select(*at_row, "x.field", "x.rule")
    listed = [of("broken")]
    at_id = lambda df, rule: df.select(*at_row, F.lit("id").alias("field"), F.lit(rule).alias("rule"))
    listed.append(at_id(changes.filter("supplied is null"), "required_internal_id") if simple else of("odd"))
    several = changes.filter("record_id is not null").groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not several.isEmpty():  # the rows themselves are dealt out only where ids repeat
        listed.append(at_id(changes.join(several, "record_id"), "unique_batch_id"))
    listed.append(at_id(changes.filter("head_class <> class"), "class_compatible_id"))
    if any(s.name == "superseded_by" for n in records for s in store.contract[n].slots):
        selves = changes.select(*at_row, F.explode("refs").alias("x")).filter("x.field = 'superseded_by' and x.target = record_id")
        listed.append(selves.select(*at_row, "x.field", F.lit("no_self_supersession").alias("rule")))
    if any(s.reference for n in records for s in store.contract[n].slots):
        lost = _broken_references(known, list(records), changes)
        listed += [lost] if lost is not None else []
    if MEASURE in records:
        listed.append(_measure_issues(store, changes))
    # a record of a valid plan has one candidate, so only a candidate's own identifiers can repeat
    named = F.array_distinct(F.transform("ids", lambda x: F.struct(x["namespace"].alias("namespace"), x["normalized"].alias("normalized"))))
    identifiers = changes.filter("record_id is not null").select("class", "record_id", F.explode(named).alias("x")).select("class", "record_id", "x.namespace", "x.normalized")
    origin = F.coalesce("origin_key", F.concat(F.lit("record-v1:"), "record_id"))
    origins = changes.filter("record_id is not null").select("class", "record_id", F.lit(provenance.producer).alias("producer"), origin.alias("origin_key"))
    issues = union(listed)
    order_free = F.sum(F.xxhash64("class", "supplied", "origin_key", "rest").cast("decimal(38,0)"))
    seen = staged.agg(F.count("*").alias("n"), order_free.alias("h")).first()
    input_digest = _hash([str(seen["n"]), str(seen["h"]), json.dumps(asdict(provenance), sort_keys=True)])
    return Plan(provenance, base, changes, _described(issues, staged), identifiers, origins, input_digest, _hash([input_digest, str(base), store.contract.build_digest()]), issues.isEmpty(), folder)


def _measure_issues(store: Store, changes: DataFrame) -> DataFrame:
    """What is wrong in the definitions of measures, each against the contract of its own target class; they are read where they are staged."""
    classes = store.contract.measurable(MEASURE)
    kind = "name string, target_class string, expr string, parameters string, dimensions string"
    rows = changes.filter(F.col("class") == MEASURE).select("class", "candidate", "record_id", F.from_json("rest", kind).alias("p")).select("class", "candidate", "record_id", "p.*")
    kinds = {"class": pa.string(), "candidate": pa.int64(), "record_id": pa.string(), "field": pa.string(), "rule": pa.string()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["class"], r["candidate"], r["record_id"], *found) for r in batch.to_pylist() for found in measures.definition_issues(r, classes)]
            yield pa.RecordBatch.from_pydict({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate(kinds.items())})

    return rows.mapInArrow(judge, "class string, candidate long, record_id string, field string, rule string")


def seed_measures(store: Store, dictionary: str, committed_at: str) -> dict[str, int]:
    """Commit the measures that a table dictionary defines, once for each of its texts: doing it again is a replay."""
    rows = measure_definitions(dictionary)
    if not rows:
        return {}
    schema = "id string, name string, title string, description string, target_class string, expr string, parameters string, dimensions string"
    frame = store.spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    key = "contract-measures:sha256:" + hashlib.sha256(dictionary.encode()).hexdigest()
    return ingest(store, {MEASURE: frame}, Provenance("contract", key), committed_at)


def _broken_references(store: Store, names: list[str], changes: DataFrame) -> DataFrame | None:
    """References to nothing, or to a class that the slot doesn't take, among the batch and the store; None where all hold."""
    refs = changes.select("class", "candidate", "record_id", F.explode("refs").alias("x")).select("class", "candidate", "record_id", "x.field", "x.target")
    asked = refs.select("class", "field", "target").distinct()
    known = changes.filter("record_id is not null").select(F.col("class").alias("target_class"), F.col("record_id").alias("target"))
    if store.pinned:
        heads = store.heads().select(F.col("class").alias("target_class"), F.col("record_id").alias("target"))
        known = known.unionByName(heads.join(asked.select("target").distinct(), "target", "left_semi"))
    takes = F.lit(False)
    for n in names:
        for s in store.contract[n].slots:
            if s.reference:
                takes = takes | ((F.col("class") == n) & (F.col("field") == s.name) & F.col("target_class").isin(*store.contract.takes(s.reference)))
    rule = F.when(F.col("target_class").isNull(), "reference_exists").when(~takes, "reference_class")
    # each target is looked up once, whatever number of rows refers to it; rows are dealt out only where some target is broken
    broken = asked.join(known, "target", "left").withColumn("rule", rule).filter("rule is not null").select("class", "field", "target", "target_class", "rule").distinct()
    return None if broken.isEmpty() else refs.join(broken, ["class", "field", "target"]).select(*ISSUE)


def _hash(parts: list[str]) -> str:
    return "sha256:" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def verify(accepted: Plan, contract_digest: str) -> dict[str, int]:
    """Refuse a plan whose staged rows or digests aren't those that it was made with; else its records by action."""
    order_free = F.sum(F.xxhash64("class", "supplied", "origin_key", "rest").cast("decimal(38,0)"))
    wrong = F.col("payload") != payload(F.col("record_id"), F.col("rest"))
    actions = ("insert", "update", "match")
    counted = [F.count_if(F.col("action") == a).alias(a) for a in actions]
    seen = accepted.changes.agg(F.count("*").alias("n"), order_free.alias("h"), F.count_if(wrong | (content_digest() != F.col("content_digest"))).alias("odd"), *counted).first()
    again = _hash([str(seen["n"]), str(seen["h"]), json.dumps(asdict(accepted.provenance), sort_keys=True)])
    if seen["odd"] or again != accepted.input_digest or _hash([again, str(accepted.base_order), contract_digest]) != accepted.plan_digest:
        raise InvalidPlanError("the plan isn't what was proposed", rule="plan_digest")
    return {a: seen[a] for a in actions if seen[a]}


def conflicts(store: Store, accepted: Plan) -> DataFrame:
    """kind and key of what a plan touches and batches after its base changed: revisions of its records, identifiers and origin keys
    that were given to other records. Only those batches are read."""
    later = lambda name: store._table(name, after=accepted.base_order)
    moved = accepted.changes.filter("record_id is not null").join(later("revisions").select("record_id").distinct(), "record_id", "left_semi")
    found = [moved.select(F.lit("record").alias("kind"), F.col("record_id").alias("key"))]
    for name, own, keys in (("identifiers", accepted.identifiers, ["class", "namespace", "normalized"]), ("origins", accepted.origins, ["class", "producer", "origin_key"])):
        others = later(name).select(*keys, F.col("record_id").alias("__other")).distinct()
        taken = own.join(others, keys).filter(F.col("__other") != F.col("record_id"))
        found.append(taken.select(F.lit(name.removesuffix("s")).alias("kind"), F.concat_ws(" ", *keys).alias("key")))
    return union(found).distinct()


def discard(store: Store, proposed: Plan) -> None:
    """Remove what a plan that won't be committed has staged."""
    store.files.remove(proposed.folder.removeprefix(f"{store.path}/"))


def commit(store: Store, accepted: Plan, committed_at: str) -> dict[str, int]:
    """Commit a valid plan as one batch; a plan that was committed before is a replay and changes nothing.

    Batches after the plan's base don't matter unless they touch what it touches (`conflicts`). What a replay or a stale plan has staged is
    removed; a refused plan keeps it, for its issues to be read, until `discard`.
    """
    same = (F.col("producer") == accepted.provenance.producer) & (F.col("idempotency_key") == accepted.provenance.idempotency_key)
    last = F.max(F.struct("commit_order", "chain", "schema_digest"))
    seen = store.log().agg(last.alias("last"), F.min(F.when(same, F.struct("commit_order", "batch_id", "plan_digest"))).alias("made")).first()
    made, order = seen["made"], seen["last"]["commit_order"] if seen["last"] else 0
    if made:
        if made["plan_digest"] != accepted.plan_digest and made["batch_id"] != _batch_id(accepted):
            raise ReplayConflictError("the idempotency key was used for other content", rule="idempotency_key")
        done = counts(store, made["batch_id"])
        discard(store, accepted)
        return done
    if not accepted.valid:
        raise InvalidPlanError("the plan has issues", rule="valid")
    done = verify(accepted, store.contract.build_digest())
    if order < accepted.base_order:
        raise StalePlanError("the store doesn't have the commit that the plan rests on", rule="base_order")
    if order > accepted.base_order:
        if not store.contract.compatible(active := store.contract_of(seen["last"]["schema_digest"])) and not store.contract.extends(active):
            raise StalePlanError("the store has another contract since the plan was made", rule="schema")
        if touched := conflicts(store, accepted).limit(1).collect():
            discard(store, accepted)
            raise StalePlanError(f"the {touched[0]['kind']} {touched[0]['key']} changed after the plan was made", rule="touched", field=touched[0]["key"])
    before, order, batch = seen["last"]["chain"] or "" if seen["last"] else "", order + 1, _batch_id(accepted)
    changed = accepted.changes.filter("action <> 'match'").withColumn("revision_number", F.coalesce("revision_number", F.lit(0)) + 1)
    fresh_id = F.concat(F.col("record_id"), F.lit("#"), F.col("revision_number").cast("string"))
    schema_digest = store.contract.build_digest()
    here = {"batch_id": F.lit(batch), "commit_order": F.lit(order)}
    revisions = changed.select(
        "class", "record_id", fresh_id.alias("revision_id"), F.col("revision_number").cast("int"), *[v.alias(k) for k, v in here.items()], F.col("action").alias("operation"),
        "content_digest", "prior_revision_id", "payload", F.coalesce("created_at", F.lit(committed_at)).alias("created_at"), F.lit(schema_digest).alias("schema_digest"),
    )
    pointed = F.when(F.col("action") == "match", F.col("prior_revision_id")).otherwise(F.concat(F.col("record_id"), F.lit("#"), (F.coalesce("revision_number", F.lit(0)) + 1).cast("string")))
    origin = F.coalesce("origin_key", F.concat(F.lit("record-v1:"), "record_id"))
    observations = accepted.changes.select("class", "record_id", *[v.alias(k) for k, v in here.items()], F.col("action").alias("disposition"), pointed.alias("revision_id"), origin.alias("origin_key"))
    registries = [df.withColumns(here).select(*columns_of(name)) for name, df in (("identifiers", accepted.identifiers), ("origins", accepted.origins))]
    store.publish(Commit(order, batch, accepted.provenance.producer, accepted.provenance.idempotency_key, accepted.plan_digest, schema_digest, committed_at), before, revisions, observations, *registries)
    discard(store, accepted)
    return done


def _batch_id(p: Plan) -> str:
    return "batch-" + hashlib.sha256(p.input_digest.encode()).hexdigest()[:26]


def counts(store: Store, batch_id: str) -> dict[str, int]:
    rows = store.observations().filter(F.col("batch_id") == batch_id).groupBy("disposition").count().collect()
    return {r["disposition"]: r["count"] for r in rows}


def ingest(store: Store, records: dict[str, DataFrame], provenance: Provenance, committed_at: str) -> dict[str, int]:
    """Plan and commit in one step."""
    return commit(store, plan(store, records, provenance), committed_at)
