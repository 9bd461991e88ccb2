"""The record store: an append-only ledger of Parquet files and one commit marker for each batch.

Layout below the store's path:

    revisions/batch=<folder>/class=<class>/...    observations/batch=<folder>/class=<class>/...    commits/<order>.json
    identifiers/batch=<folder>/class=<class>/...  origins/batch=<folder>/class=<class>/...          contracts/<digest>.json

A batch's files are written first, below a folder of their own, and its marker last, by an exclusive create; readers join the files with the
folders that markers name, so a second writer of the same batch touches nothing that others read. So a commit is atomic over all classes, the order is dense and unique, and files of a failed commit are never
read, on file systems where creating a file that must not exist yet is atomic (local ones, HDFS). On object stores without such a create
two writers must not commit at once. Heads are derived by a window, nothing is rewritten. Markers are read as one frame and
files as one table by Spark, and questions about commits are aggregates of that frame; a read of one class lists its folders only.

Every marker holds a digest of itself and of the marker before it, free of paths: a snapshot names the last of them, so a copied
store takes it and a store whose log was edited doesn't. Every read of a record's content compares it with its digest while it is read.

A store may be opened with a contract that adds to the one it has (`evolve=True`): revisions keep the digest of the contract that they were
written under, and `revised` reads each of them by that contract.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError, HistoryError, ReferenceError_, SnapshotBoundaryError, SnapshotError, StalePlanError
from ..functions import digest, strict_timestamp
from ..functions.columns import UNIT
from ..operators import ledger
from .contract import STRICT, Contract, RecordClass, Slot

REVISION = "class string, record_id string, revision_id string, revision_number int, batch_id string, commit_order int, operation string, content_digest string, prior_revision_id string, payload string, created_at string, schema_digest string"
OBSERVATION = "class string, record_id string, batch_id string, commit_order int, disposition string, revision_id string, origin_key string"
IDENTIFIER = "class string, record_id string, namespace string, normalized string, batch_id string, commit_order int"
ORIGINS = "class string, record_id string, producer string, origin_key string, batch_id string, commit_order int"
TABLES = {"revisions": REVISION, "observations": OBSERVATION, "identifiers": IDENTIFIER, "origins": ORIGINS}
COMMIT = "commit_order int, batch_id string, producer string, idempotency_key string, plan_digest string, schema_digest string, committed_at string, folder string, chain string"
#: What the digest of a marker covers, beside the digest of the marker before.
CHAINED = ("commit_order", "batch_id", "producer", "idempotency_key", "plan_digest", "schema_digest", "committed_at", "folder")


def columns_of(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


@dataclass(frozen=True)
class Commit:
    commit_order: int
    batch_id: str
    producer: str
    idempotency_key: str
    plan_digest: str
    schema_digest: str
    committed_at: str
    folder: str = ""
    chain: str = ""


@dataclass(frozen=True)
class Snapshot:
    """A boundary of a store that can be kept as text: later commits change nothing that is read at it.

    With its digest, of the whole log up to the boundary, it holds for any copy of the store; without, for the store at its path.
    """

    path: str
    commit_order: int
    batch_id: str
    committed_at: str
    schema_digest: str
    digest: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


class Files:
    """The few file operations that frames don't have, through Spark's own file system layer."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        """Write a new file; false if it is there already."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as e:
            if "exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def exist(self, pattern: str) -> bool:
        """Whether a path, or one that matches a pattern, is there."""
        return len(self.fs.globStatus(self.path(pattern)) or ()) > 0

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class Store:
    """Reads of a store, at its latest boundary or at a pinned one."""

    def __init__(self, spark: SparkSession, path: str, contract: Contract, pinned: int | None = None, read_only: bool = False):
        self.spark, self.path, self.contract, self.pinned, self.read_only = spark, path.rstrip("/"), contract, pinned, read_only
        self.files = Files(spark, self.path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, contract: Contract, read_only: bool = False, evolve: bool = False) -> Store:
        """Open a store, or make one; the contract must mean what the store's contract means, or, to evolve it, add to it."""
        store = cls(spark, path, contract, read_only=read_only)
        active = store.active_contract()
        if active is not None:
            if not active.compatible(contract) and not (evolve and contract.extends(active)):
                raise SnapshotError("the store has a contract of other structure", rule="schema_mismatch")
        elif read_only:
            raise ReferenceError_(f"no store at {path}", rule="store_exists")
        if not read_only:
            store.files.create(f"contracts/{contract.build_digest().split(':')[1]}.json", contract.to_json())
        return store

    def contract_of(self, schema_digest: str) -> Contract:
        """The contract that a build digest stands for, as the store keeps it."""
        name = f"contracts/{schema_digest.split(':')[-1]}.json"
        if not self.files.fs.exists(self.files.path(name)):
            raise SnapshotError(f"the contract {schema_digest} is missing", rule="schema_presence")
        found = Contract.from_json(self.files.text(name))
        if found.build_digest() != schema_digest:
            raise ContractError(f"the contract {schema_digest} was changed", rule="schema_digest")
        return found

    def _digests(self) -> list[str]:
        return [f"sha256:{n.removesuffix('.json')}" for n in self.files.names("contracts")]

    def active_contract(self) -> Contract | None:
        """The contract of the last commit, or the one that the store was made with."""
        known = self.files.names("contracts")
        if len(known) > 1:
            last = self.log().agg(F.max_by("schema_digest", "commit_order")).first()[0]
            known = [f"{last.split(':')[1]}.json"] if last else known
        return Contract.from_json(self.files.text(f"contracts/{known[0]}")) if known else None

    # ---- boundaries

    def log(self) -> DataFrame:
        """The commit markers up to the boundary, as a frame."""
        found = self._whole_log()
        return found if self.pinned is None else found.filter(F.col("commit_order") <= self.pinned)

    def _whole_log(self) -> DataFrame:
        if not self.files.fs.exists(self.files.path("commits")):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.path}/commits")

    def commits(self, *conditions) -> list[Commit]:
        """The commits in order, those that meet the conditions."""
        found = self.log()
        for c in conditions:
            found = found.filter(c)
        return sorted((Commit(**r.asDict()) for r in found.collect()), key=lambda c: c.commit_order)

    def broken_log(self) -> DataFrame:
        """Markers up to the boundary whose digest isn't that of their content after the marker before, or that have none before."""
        before = self.log().select((F.col("commit_order") + 1).alias("commit_order"), F.col("chain").alias("before"))
        chained = self.log().join(before, "commit_order", "left")
        first = F.col("commit_order") == 1
        again = digest_of(F.when(first, F.lit("")).otherwise(F.col("before")), *[F.col(c) for c in CHAINED])
        return chained.filter(~F.coalesce(again == F.col("chain"), F.lit(False))).select("commit_order", "batch_id", "chain")

    def snapshot(self) -> Snapshot:
        names = ("commit_order", "batch_id", "committed_at", "schema_digest", "chain")
        last = self.log().agg(F.max(F.struct(*names)).alias("x")).select("x.*").first()
        if last["commit_order"] is None:
            return Snapshot(self.path, 0, "", "", self.contract.build_digest())
        return Snapshot(self.path, *[last[n] for n in names[:4]], last["chain"] or "")

    def at(self, snapshot: Snapshot) -> Store:
        """A read-only view of the store at a snapshot of it, or of the store that it is a copy of; it reads by the contract of that time."""
        if snapshot.path != self.path and not snapshot.digest:
            raise SnapshotError("the snapshot is another store's", rule="store_mismatch")
        contract = self.contract
        if snapshot.commit_order:
            found = self.commits(F.col("commit_order") == snapshot.commit_order)
            if [c.batch_id for c in found] != [snapshot.batch_id]:
                raise SnapshotError("the store has no such boundary", rule="boundary")
            if found[0].schema_digest != snapshot.schema_digest or found[0].committed_at != snapshot.committed_at:
                raise SnapshotError("the boundary was committed under another contract or at another time", rule="schema_digest")
            if snapshot.digest and found[0].chain != snapshot.digest:
                raise SnapshotError("the log up to the boundary isn't the one that the snapshot was taken of", rule="snapshot_digest")
            contract = self.contract_of(snapshot.schema_digest)
        view = Store(self.spark, self.path, contract, snapshot.commit_order, True)
        if snapshot.digest and not view.broken_log().isEmpty():
            raise SnapshotError("the log up to the boundary was changed", rule="snapshot_digest")
        return view

    def boundary(self, at: str) -> int:
        """The commit order at a batch id, or the last one committed up to a time (0: none was).

        Anything else is an error, and so is a boundary later than the one that the store is pinned to.
        """
        time = strict_timestamp(F.lit(at))
        pinned = F.lit(-1 if self.pinned is None else self.pinned)
        found = self._whole_log().agg(
            F.max(F.when(F.col("batch_id") == at, F.col("commit_order"))).alias("named"),
            F.max(F.when(strict_timestamp(F.col("committed_at")) <= time, F.col("commit_order"))).alias("before"),
            F.max(F.when(F.col("commit_order") == pinned, strict_timestamp(F.col("committed_at")) < time)).alias("later"),
        ).select("*", time.isNotNull().alias("is_time")).first()
        if found["named"] is None and not found["is_time"]:
            raise HistoryError(f"{at} is neither a committed batch nor a time", rule="history_boundary", field="as_of")
        order = found["named"] if found["named"] is not None else found["before"] or 0
        if self.pinned is not None and (order > self.pinned or (found["named"] is None and found["later"])):
            raise SnapshotBoundaryError(f"{at} is later than the snapshot", rule="history_boundary", field="as_of")
        return order

    # ---- frames

    def _table(self, name: str, record_class: str | None = None, after: int = 0) -> DataFrame:
        """The rows of a table of committed batches after an order and up to the boundary; of one class, from its folders alone."""
        schema = TABLES[name]
        folder, below = f"{self.path}/{name}", name
        if record_class is not None and re.fullmatch(r"\w+", record_class):
            below = f"{name}/batch=*/class={record_class}"
        if not self.files.exist(below) or not self.files.exist("commits"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch string").option("basePath", folder).parquet(f"{self.path}/{below}")
        if record_class is not None:
            rows = rows.filter(F.col("class") == record_class)
        named = self.log().filter(F.col("commit_order") > after).select(F.coalesce("folder", "batch_id").alias("batch"))
        return rows.join(F.broadcast(named) if self.few_commits() else named, "batch", "left_semi").select(*columns_of(name))

    def few_commits(self) -> bool:
        """Whether the commit markers may be broadcast: so many files at most."""
        return self.files.fs.getContentSummary(self.files.path("commits")).getFileCount() <= 100_000

    def batches(self) -> DataFrame:
        return self.log().select("batch_id", "commit_order", "committed_at", F.lit("committed").alias("status"), "schema_digest", "producer")

    def origins(self) -> DataFrame:
        return self._table("origins").groupBy("class", "producer", "origin_key").agg(F.min_by("record_id", "commit_order").alias("record_id"), F.min("commit_order").alias("commit_order"))

    def revisions(self, record_class: str | None = None) -> DataFrame:
        return self._table("revisions", record_class)

    def observations(self) -> DataFrame:
        return self._table("observations")

    def identifiers(self) -> DataFrame:
        own = self._table("identifiers")
        from ..operators.search import register

        return register(own.select("class", "record_id", "namespace", F.col("normalized").alias("value"), F.col("commit_order").alias("first_order")))

    def heads(self, record_class: str | None = None, ids: DataFrame | list[str] | None = None) -> DataFrame:
        """The latest revisions, all or those of ids (a list, or a frame with a column record_id of any size), picked before rows are dealt by record.
        Whoever reads a payload compares it with its digest; a forged one is an error of the read."""
        found = self.revisions(record_class)
        if isinstance(ids, list):
            found = found.filter(F.col("record_id").isin(ids))
        elif ids is not None:
            found = found.join(ids.select("record_id"), "record_id", "left_semi").select(*found.columns)
        return checked_payload(ledger.latest(found))

    def records(self, name: str, public: bool = True, digests: bool = False, holding: str | None = None, ids: DataFrame | list[str] | None = None) -> DataFrame:
        """The current records of a class as typed columns; sensitive ones are left out. digests: with `.content_digest`.
        holding: a text, without those whose payload has it nowhere, whatever its case; they are left out before payloads are parsed.
        ids: only these, a list or a frame with a column record_id of any size."""
        own = self.contract[name]
        slots = own.public_slots() if public else [s.name for s in own.slots]
        heads = self.heads(name, ids)
        if holding is not None:
            heads = heads.filter(F.contains(F.lower("payload"), F.lit(json.dumps(holding, ensure_ascii=False)[1:-1].lower())))
        kind = self.payload_type(name)
        parsed = heads.select("record_id", "revision_number", F.col("content_digest").alias(".content_digest"), F.from_json("payload", kind).alias("p"))
        typed = {s.name: typed_cell(F.col("p"), s) for s in own.slots if s.name in kind.names}
        more = ["`.content_digest`"] if digests else []
        return parsed.select("record_id", "revision_number", *more, *[typed[s].alias(s) for s in slots if s not in ("id", "created_at", "updated_at")])

    def payload_type(self, name: str) -> T.StructType:
        return payload_type(self.contract[name])

    def get(self, record_id: str) -> dict:
        """One record with its identifiers."""
        row = self.heads().filter(F.col("record_id") == record_id).first()
        if row is None:
            raise ReferenceError_(f"no record {record_id}", rule="reference_exists", field="id")
        public = set(self.contract[row["class"]].public_slots())
        record = {k: v for k, v in json.loads(row["payload"]).items() if k in public}
        ids = [r.asDict() for r in self.identifiers().filter(F.col("record_id") == record_id).orderBy("namespace", "normalized").limit(1001).collect()]
        return {"class": row["class"], "id": record_id, "record": record, "identifiers": ids[:1000], "truncated": len(ids) > 1000}

    def find(self, query: str, name: str) -> DataFrame:
        from ..operators.search import find

        return find(self.records(name), list(self.contract[name].search_slots), query)

    def history(self, record_id: str | None = None, as_of: str | None = None) -> DataFrame:
        """Revisions, newest first, up to a boundary (see `boundary`)."""
        return ledger.history(checked_payload(self.revisions()), record_id, None if as_of is None else self.boundary(as_of))

    def revised(self, name: str, record_id: str | None = None, as_of: str | None = None) -> DataFrame:
        """The revisions of a class, each read by the contract that it was written under, in one scan.

        Columns: those of the ledger, `fields` (the public slots that its contract has, so a slot that didn't exist differs from an empty one),
        `changed_fields` (those whose values differ from the revision before), and every slot that is public in some contract; it is
        null where it is restricted in a revision's own contract. Slots whose types differ between contracts are text. A revision whose contract the store doesn't have is an error of the read.
        """
        up_to = None if as_of is None else self.boundary(as_of)
        known = {d: self.contract_of(d) for d in self._digests()}
        own = {d: c[name] for d, c in known.items() if name in c.classes}
        rows = checked_payload(self.revisions(name) if record_id is None else self.revisions(name).filter(F.col("record_id") == record_id))
        known_digest = F.col("schema_digest").isin(*own) if own else F.lit(False)
        lost = F.raise_error(F.concat(F.lit("no contract "), F.coalesce("schema_digest", F.lit("(none)")), F.lit(f" with a class {name}")))
        rows = rows.withColumn("payload", F.when(known_digest, F.col("payload")).otherwise(lost))
        values = F.from_json("payload", "map<string,string>")
        before = F.lag("payload").over(W.partitionBy("class", "record_id").orderBy("revision_number"))
        rows = rows.withColumn("__before", F.from_json(before, "map<string,string>")).withColumn("__values", values)
        rows = rows if up_to is None else rows.filter(F.col("commit_order") <= up_to)
        if not own:
            return rows.select("record_id", "revision_number", "commit_order", "operation", "schema_digest", F.array().cast("array<string>").alias("fields"), F.array().cast("array<string>").alias("changed_fields"))

        def by_contract(of: Callable[[RecordClass], Column]) -> Column:
            out = None
            for d, c in own.items():
                out = F.when(F.col("schema_digest") == d, of(c)) if out is None else out.when(F.col("schema_digest") == d, of(c))
            return out

        skipped = ("id", "created_at", "updated_at")
        public = lambda c: sorted(s for s in c.public_slots() if s not in skipped)
        rows = rows.withColumn("fields", by_contract(lambda c: F.array(*[F.lit(s) for s in public(c)]).cast("array<string>")))
        differs = lambda k: F.col("__before").isNull() | ~F.col("__before")[k].eqNullSafe(F.col("__values")[k])
        rows = rows.withColumn("changed_fields", F.filter("fields", differs))
        for i, (d, c) in enumerate(own.items()):
            rows = rows.withColumn(f"__p{i}", F.when(F.col("schema_digest") == d, F.from_json("payload", payload_type(c))))
        slots: dict[str, list[tuple[int, Slot]]] = {}
        for i, c in enumerate(own.values()):
            for s in c.slots:
                if s.name not in skipped and not s.sensitive:
                    slots.setdefault(s.name, []).append((i, s))
        typed = []
        for slot, where in sorted(slots.items()):
            one_type = len({(s.type, s.multivalued) for _, s in where}) == 1
            cells = [typed_cell(F.col(f"__p{i}"), s) if one_type else F.col("__values")[slot] for i, s in where]
            shown = [F.when(F.col(f"__p{i}").isNotNull(), cell) for (i, _), cell in zip(where, cells, strict=True)]
            typed.append(F.coalesce(*shown).alias(slot))
        return rows.select("record_id", "revision_number", "commit_order", "operation", "schema_digest", "fields", "changed_fields", *typed)

    # ---- writing

    def publish(self, commit: Commit, before: str, revisions: DataFrame, observations: DataFrame, identifiers: DataFrame, origins: DataFrame) -> None:
        """Write a batch and then its marker, chained to the one before; if another commit took the order meanwhile, nothing becomes visible."""
        if self.pinned is not None or self.read_only:
            raise SnapshotError("a pinned or read-only store takes no commits", rule="read_only")
        commit = replace(commit, folder=f"{commit.batch_id}.{uuid.uuid4().hex[:12]}")
        commit = replace(commit, chain=chain_digest(before, commit))

        def write(name: str, rows: DataFrame) -> None:
            # digests are half of a row and hexadecimal text: zstd halves them
            rows.write.option("compression", "zstd").partitionBy("class").parquet(f"{self.path}/{name}/batch={commit.folder}")

        with ThreadPoolExecutor(len(TABLES)) as pool:  # four jobs at once; the first error is raised
            list(pool.map(write, TABLES, (revisions, observations, identifiers, origins)))
        if not self.files.create(f"commits/{commit.commit_order:012d}.json", json.dumps(asdict(commit), sort_keys=True)):
            for name in TABLES:
                self.files.remove(f"{name}/batch={commit.folder}")
            raise StalePlanError("another batch was committed first", rule="commit_order")

    def audit(self) -> DataFrame:
        """Issues of the ledger, its registries and its payloads. Heads are derived here, so there are no checks of them."""
        from ..operators.integrity import audit, payload_issues

        rev = self.revisions()
        registered = [self._table(n).select("class", "record_id").distinct() for n in ("identifiers", "origins")]
        found = audit(rev, self.observations(), self.batches(), None, self.log().select("schema_digest").distinct(), *registered, ["payload"])
        # payloads are canonical by the contract that they were written under
        mine = [d for d in self._digests() if self.contract_of(d).compatible(self.contract)]
        for c in self.contract.classes.values():
            found = found.unionByName(payload_issues(self.revisions(c.name).filter(F.col("schema_digest").isin(mine)), self.payload_type(c.name)))
        return found


def payload_type(own: RecordClass) -> T.StructType:
    """The type of a class's JSON payload: its id, then its slots; exact numbers and times are text there."""
    exact = lambda s: s.type in ("integer", "decimal", "datetime") and not s.multivalued
    kinds = {s.name: T.StringType() if exact(s) else own.struct_type()[s.name].dataType for s in own.slots if s.name not in ("id", "created_at", "updated_at")}
    return T.StructType([T.StructField("id", T.StringType()), *[T.StructField(k, v) for k, v in kinds.items()]])


def typed_cell(parsed: Column, slot: Slot) -> Column:
    """A slot of a parsed payload in the slot's type."""
    exact = slot.type in ("string", "integer", "decimal", "datetime", "time") and not slot.multivalued
    return STRICT[slot.type](parsed[slot.name]) if exact else parsed[slot.name]


def digest_of(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def chain_digest(before: str, commit: Commit) -> str:
    text = UNIT.join([before, *[str(getattr(commit, c)) for c in CHAINED]])
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def checked_payload(revisions: DataFrame) -> DataFrame:
    """revisions, whose payload can only be read where it has its digest."""
    forged = F.raise_error(F.concat(F.lit("the payload of revision "), "revision_id", F.lit(" doesn't have its content digest")))
    return revisions.withColumn("payload", F.when(content_digest() == F.col("content_digest"), F.col("payload")).otherwise(forged))


def content_digest(payload: str = "payload"):
    return digest(F.col(payload))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
