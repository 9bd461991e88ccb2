"""Reads of a store by the roles of its classes: claims, evidence, mentions, the graph, measures, and one call for all of them.

Frames (`nodes`, `edges`, `claim_rows`, `evidence_rows`, `evidence_of`) are whole and lazy. The reads beside them answer one question within caps
and say in `truncated` whether more was there. A pinned store gives the same reads at its boundary.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import IdentityError, LimitError, MeasureError, RecordError, ReferenceError_, SnapshotError
from ..functions import first_label
from ..operators import graph, measures, search
from .contract import MEASURE, Contract, RecordClass, Slot
from .store import Store

#: Most rows of each read, most nodes, edges and hops of a graph read.
CAPS = {"identifiers": 1000, "lookup": 1000, "claims": 1000, "evidence": 2000, "unresolved": 5000, "measures": 1000, "integrity": 1000, "find": 1000, "nodes": 500, "edges": 2000, "hops": 2}
#: Order of the edges of an answer.
EDGE_ORDER = ("subject", "predicate", "object", "edge_class", "edge_id")
SUPPORT = ("supports", "contradicts", "mentions", "derived_from")
CLAIM = ["class", "record_id", "shape", "subject", "predicate", "object_entity", "object_value", "about", "statement_text", "status"]
EVIDENCE = ["class", "record_id", "statement_id", "source_id", "support_type", "source_uri", "source_title"]


@dataclass(frozen=True)
class Page:
    """A bounded answer."""

    rows: list[Row]
    limit: int
    truncated: bool


@dataclass(frozen=True)
class Subgraph:
    nodes: list[Row]
    edges: list[Row]
    truncated: bool


def measured(contract: Contract) -> Contract:
    """The contract with a class of measure records."""
    slots = [Slot("id", required=True, identifier=True), *[Slot(n, required=n in ("name", "target_class", "expr")) for n in ("name", "title", "description", "target_class", "expr", "parameters", "dimensions")]]
    own = RecordClass(MEASURE, tuple(slots), (MEASURE,), "metadata", "require", "name", ("title", "description"))
    return replace(contract, classes={**contract.classes, MEASURE: own})


def page(df: DataFrame, order: list[str], limit: int, most: int) -> Page:
    """The first rows in a total order; only limit + 1 rows reach the driver."""
    if not 1 <= limit <= most:
        raise LimitError(f"limit must be 1 to {most}", rule="limit", field="limit")
    rows = df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(limit + 1).collect()
    return Page(rows[:limit], limit, len(rows) > limit)


class Knowledge:
    def __init__(self, store: Store):
        self.store, self.contract = store, store.contract

    @property
    def measured(self) -> bool:
        """Whether the contract has the class of measures."""
        return MEASURE in self.contract.classes

    def classes(self, *roles: str) -> list[RecordClass]:
        return [c for c in self.contract.classes.values() if c.role in roles]

    def _class_of(self, record_id: str) -> RecordClass:
        found = self.store.heads().filter(F.col("record_id") == record_id).select("class").distinct().collect()
        if not found:
            raise ReferenceError_(f"no record {record_id}", rule="record_exists", field="id")
        return self.contract[found[0]["class"]]

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        out = parts[0] if parts else self.store.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # ---- search

    def find_rows(self, query: str, record_class: str | None = None) -> DataFrame:
        """id, class, label, matched_fields and record (JSON of the public slots) of all records that have the query, whatever its case, in their label or a searched slot."""
        if not query.strip():
            raise RecordError("the query is empty", rule="query", field="query")
        own = [self.contract[record_class]] if record_class else list(self.contract.classes.values())
        parts = []
        for c in own:
            fields = sorted({*c.search_slots, *([c.label_slot] if c.label_slot else [])} - {s.name for s in c.slots if s.sensitive})
            if not fields:
                continue
            rows = self.store.records(c.name, holding=query)
            shown = F.to_json(F.struct(F.col("record_id").alias("id"), *[F.col(f"`{s}`") for s in c.public_slots() if s in rows.columns]), {"ignoreNullFields": "false"})
            label = first_label(*[F.col(f"`{s}`") for s in ([c.label_slot] if c.label_slot else [])], F.col("record_id"))
            matched = F.array_compact(F.array(*[F.when(F.contains(F.lower(F.col(f"`{f}`")), F.lit(query.lower())), F.lit(f)) for f in fields]))
            found = rows.select(F.col("record_id").alias("id"), F.lit(c.name).alias("class"), label.alias("label"), matched.alias("matched_fields"), shown.alias("record"))
            parts.append(found.filter(F.size("matched_fields") > 0))
        return self._union(parts, "id string, class string, label string, matched_fields array<string>, record string")

    def find(self, query: str, record_class: str | None = None, limit: int = 20) -> Page:
        """The first records that have the query, by class and id."""
        return page(self.find_rows(query, record_class), ["class", "id"], limit, CAPS["find"])

    # ---- identifiers

    def identifiers(self, id: str, limit: int = 100) -> Page:  # noqa: A002
        """A record's registered identifiers of public slots, by rank of status."""
        own = self._class_of(id)
        public = [s.namespace for s in own.slots if s.namespace and not s.sensitive]
        rows = self.store.identifiers().filter((F.col("record_id") == id) & F.col("namespace").isin(public)).withColumn("rank", search.status_rank(F.col("status")))
        return page(rows.select("class", "record_id", "namespace", "normalized", "status", "rank"), ["rank", "namespace", "normalized"], limit, CAPS["identifiers"])

    def lookup(self, namespace: str, value: str, record_class: str | None = None, limit: int = 100) -> Page:
        """Records that an identifier stands for, in the classes that have a public slot of its namespace."""
        eligible = [c.name for c in self.contract.classes.values() if any(s.namespace == namespace and not s.sensitive for s in c.slots) and record_class in (None, c.name)]
        if record_class is not None:
            self.contract[record_class]
        wanted = self.store.spark.createDataFrame([(namespace, value)], "namespace string, value string")
        found = search.lookup(self.store.identifiers().filter(F.col("class").isin(eligible)), wanted)
        out = page(found.select("class", "record_id", "namespace", "normalized", "status", "n_records"), ["class", "record_id"], limit, CAPS["lookup"])
        if several := [r for r in out.rows if r["n_records"] > 1]:
            raise IdentityError(f"{value} stands for several records of {several[0]['class']}", rule="unique_exact_identity", field=namespace)
        return out

    # ---- claims, evidence, mentions

    def claim_rows(self) -> DataFrame:
        """All current statements, narrative and semantic ones in one form."""
        parts = []
        for c in self.classes("statement"):
            have = {s.name: s for s in c.slots}
            semantic = {"subject", "predicate"} <= set(have)
            text = lambda n: (F.col(n).cast("string") if n in have and not have[n].multivalued else F.lit(None).cast("string")).alias(n)  # noqa: B023, E731
            about = F.col("about") if "about" in have and have["about"].multivalued else F.array().cast("array<string>")
            subject = text("subject") if semantic else text("primary_subject").alias("subject")
            parts.append(
                self.store.records(c.name).select(
                    F.lit(c.name).alias("class"), "record_id", F.lit("semantic" if semantic else "narrative").alias("shape"), subject, text("predicate"), text("object_entity"), text("object_value"),
                    F.coalesce(about, F.array().cast("array<string>")).alias("about"), text("statement_text"), text("status"),
                )
            )
        return self._union(parts, ", ".join(f"`{c}` {'array<string>' if c == 'about' else 'string'}" for c in CLAIM))

    def claims(self, id: str, predicate: str | None = None, include_superseded: bool = False, limit: int = 50) -> Page:  # noqa: A002
        self._class_of(id)
        return page(search.claims(self.claim_rows(), id, predicate, include_superseded), ["class", "record_id"], limit, CAPS["claims"])

    def _claims_of_all_classes(self, id: str, limit: int) -> Page:  # noqa: A002
        """The active claims about a record, those of a class by id, as many of each class as fit: a class of many doesn't crowd out the others."""
        place = F.row_number().over(W.partitionBy("class").orderBy("record_id"))
        rows = search.claims(self.claim_rows(), id).withColumn("place", place).filter(F.col("place") <= limit + 1)
        out = page(rows, ["place", "class", "record_id"], limit, CAPS["claims"])
        return replace(out, rows=sorted((Row(**{c: r[c] for c in CLAIM}) for r in out.rows), key=lambda r: (r["class"], r["record_id"])))

    def evidence_rows(self) -> DataFrame:
        """All current evidence with its source's address and title."""
        parts = [self.store.records(c.name).select(F.lit(c.name).alias("class"), "record_id", *[F.col(n).cast("string").alias(n) for n in ("statement_id", "source_id", "support_type")]) for c in self.classes("evidence")]
        own = self._union(parts, "class string, record_id string, statement_id string, source_id string, support_type string")
        texts = []
        for c in self.classes("source"):
            have = {s.name for s in c.slots if not s.sensitive}
            either = lambda n: F.col(n).cast("string") if n in have else F.lit(None).cast("string")  # noqa: B023, E731
            texts.append(self.store.records(c.name).select(F.col("record_id").alias("source_id"), either("uri").alias("source_uri"), F.coalesce(either("title"), either(c.label_slot or "title")).alias("source_title"), F.lit(True).alias("there")))
        return own.join(self._union(texts, "source_id string, source_uri string, source_title string, there boolean"), "source_id", "left")

    def evidence_of(self, statement_id: str | None = None, source_id: str | None = None, entity_id: str | None = None, support_type: str | None = None) -> DataFrame:
        """All evidence of a statement, from a source, or for the claims about an entity, however much there is."""
        if statement_id is source_id is entity_id is None:
            raise RecordError("evidence needs a statement, a source or an entity", rule="evidence_scope")
        if support_type is not None and support_type not in SUPPORT:
            raise RecordError(f"{support_type} is no kind of support", rule="support_type", field="support_type")
        rows = self.evidence_rows()
        for name, value in (("statement_id", statement_id), ("source_id", source_id), ("support_type", support_type)):
            if value is not None:
                rows = rows.filter(F.col(name) == value)
        if entity_id is not None:
            rows = rows.join(search.claims(self.claim_rows(), entity_id).select(F.col("record_id").alias("statement_id")).distinct(), "statement_id", "left_semi")
        return rows

    def evidence(self, statement_id: str | None = None, source_id: str | None = None, entity_id: str | None = None, support_type: str | None = None, limit: int = 100) -> Page:
        """The first of `evidence_of` by class and id."""
        out = page(self.evidence_of(statement_id, source_id, entity_id, support_type), ["class", "record_id"], limit, CAPS["evidence"])
        if lost := [r for r in out.rows if r["source_id"] is not None and not r["there"]]:
            raise ReferenceError_(f"no source {lost[0]['source_id']}", rule="reference_exists", field="source_id")
        return replace(out, rows=[Row(**{c: r[c] for c in EVIDENCE}) for r in out.rows])

    def unresolved(self, record_class: str | None = None, source_id: str | None = None, limit: int = 100) -> Page:
        """Mentions that no entity has been found for."""
        own = [c for c in self.classes("mention") if record_class in (None, c.name)]
        parts = [self.store.records(c.name).select(F.lit(c.name).alias("class"), "record_id", "source_id", "surface_form", "entity_id") for c in own]
        rows = search.unresolved(self._union(parts, "class string, record_id string, source_id string, surface_form string, entity_id string"))
        return page(rows if source_id is None else rows.filter(F.col("source_id") == source_id), ["class", "record_id"], limit, CAPS["unresolved"])

    # ---- graph

    def nodes(self, ids: list[str] | None = None) -> DataFrame:
        """All nodes, or those of a list of ids."""
        parts = []
        for c in self.classes(*graph.NODE_ROLES):
            label = F.col(c.label_slot).cast("string") if c.label_slot else F.lit(None).cast("string")
            parts.append(self.store.records(c.name, ids=ids).select(F.col("record_id").alias("id"), F.lit(c.name).alias("class"), label.alias("label"), F.lit(c.role).alias("role")))
        return self._union(parts, "id string, class string, label string, role string")

    def edges(self, projection: str = "combined") -> DataFrame:
        """Edges that the roles of classes and slots give: semantic ones, those of provenance, or both.

        Semantic: edge records, and semantic statements with an object. Provenance: a narrative statement's subject and each
        entry of `about`, a statement's evidence, evidence's source, a successor, a mention's entity, what a semantic statement is derived from.
        """
        if projection not in ("semantic", "provenance", "combined"):
            raise RecordError(f"no projection {projection}", rule="projection", field="projection")
        parts = []
        for c in self.classes("edge", "statement", "evidence", "mention"):
            have, rows = {s.name: s for s in c.slots}, self.store.records(c.name)
            kinds: list[tuple[str, str, str, Column, str]] = []  # layer, subject, object, predicate, kind
            if c.role in ("edge", "statement") and {"subject", "predicate"} <= set(have):
                kinds.append(("semantic", "subject", "object" if c.role == "edge" else "object_entity", F.col("predicate"), "semantic"))
                kinds.append(("provenance", "record_id", "derived_from_statement", F.lit("derived_from_statement"), "semantic_derivation"))
            elif c.role == "statement":
                kinds.append(("provenance", "record_id", "primary_subject", F.lit("primary_subject"), "primary_subject"))
                if "about" in have and projection != "semantic":
                    parts.append(graph.about_edges(rows))
            if c.role == "statement":
                kinds.append(("provenance", "record_id", "superseded_by", F.lit("superseded_by"), "superseded_by"))
            if c.role == "evidence":
                kinds.append(("provenance", "statement_id", "record_id", F.lit("evidence"), "statement_evidence"))
                kinds.append(("provenance", "record_id", "source_id", F.lit("source_id"), "evidence_source"))
            if c.role == "mention":
                kinds.append(("provenance", "record_id", "entity_id", F.lit("entity_id"), "mention_entity"))
            for layer, a, b, predicate, kind in kinds:
                if projection in (layer, "combined") and all(x == "record_id" or x in have for x in (a, b)):
                    name = F.col("record_id") if layer == "semantic" else F.concat(F.col("record_id"), F.lit(f"#{kind}"))
                    parts.append(graph.edges(rows, F.col(a), predicate.cast("string"), F.col(b), kind, layer, name))
        return self._union(parts, ", ".join(f"{c} string" for c in graph.EDGE))

    def _expand(self, root: str, predicates: list[str | None], direction: str, projection: str, max_nodes: int, max_edges: int) -> Subgraph:
        """Breadth first within the caps: each hop takes the first edges by id, then the first new nodes by id."""
        for name, value, most in (("max_nodes", max_nodes, CAPS["nodes"]), ("max_edges", max_edges, CAPS["edges"]), ("hops", len(predicates), CAPS["hops"])):
            if not 1 <= value <= most:
                raise LimitError(f"{name} must be 1 to {most}", rule="limit", field=name)
        if direction not in ("out", "in", "both"):
            raise RecordError(f"no direction {direction}", rule="direction", field="direction")
        self._class_of(root)
        all_edges, spark = self.edges(projection), self.store.spark
        visited, frontier, kept, truncated = {root}, {root}, {}, False
        for predicate in predicates:
            if not frontier:
                break
            at = spark.createDataFrame([(root, x, 0) for x in sorted(frontier)], "root string, id string, hop int")
            left = max_edges - len(kept)
            found = graph.expand(at, all_edges, direction, predicate).select(*graph.EDGE).distinct()
            rows = found.orderBy("edge_id", "subject", "object").limit(left + len(kept) + 1).collect()  # max_edges + 1 at most
            fresh = [r for r in rows if (r["layer"], r["edge_id"]) not in kept]
            truncated |= len(fresh) > left
            fresh = fresh[:left]
            new = sorted({x for r in fresh for x in (r["subject"], r["object"])} - visited)
            truncated |= len(new) > max_nodes - len(visited)
            frontier = set(new[: max_nodes - len(visited)])
            visited |= frontier
            inside = [r for r in fresh if r["subject"] in visited and r["object"] in visited]
            truncated |= len(inside) < len(fresh)
            kept |= {(r["layer"], r["edge_id"]): r for r in inside}
        nodes = self.nodes(sorted(visited)).select("id", "class", "label", "role").collect()
        by_id: dict[str, Row] = {}
        for n in nodes:
            if n["id"] in by_id:
                raise IdentityError(f"{n['id']} is a node of several classes", rule="unique_node_class", field="graph")
            by_id[n["id"]] = n
        if lost := sorted(visited - set(by_id)):
            raise ReferenceError_(f"no node {lost[0]}", rule="graph_endpoint_exists", field="graph")
        return Subgraph([by_id[x] for x in sorted(by_id)], sorted(kept.values(), key=lambda r: tuple(r[c] or "" for c in EDGE_ORDER)), truncated)

    def neighbors(self, id: str, predicate: str | None = None, direction: str = "both", hops: int = 1, projection: str = "combined", max_nodes: int = 100, max_edges: int = 500) -> Subgraph:  # noqa: A002
        return self._expand(id, [predicate] * hops, direction, projection, max_nodes, max_edges)

    def traverse(self, start: str, via: list[str], direction: str = "out", projection: str = "combined", max_nodes: int = 100, max_edges: int = 500) -> Subgraph:
        """One predicate for each hop."""
        return self._expand(start, list(via), direction, projection, max_nodes, max_edges)

    # ---- one record, measures, the dispatcher

    def get(self, id: str, include: tuple[str, ...] = ("identifiers", "claims", "evidence"), limits: dict[str, int] | None = None) -> dict:  # noqa: A002
        """One record with what belongs to it; evidence is that of a statement, from a source, or for the claims about a node."""
        if odd := [x for x in (*include, *(limits or {})) if x not in ("identifiers", "claims", "evidence")]:
            raise RecordError(f"get includes no {odd[0]}", rule="include", field="include")
        own, most = self._class_of(id), {"identifiers": 100, "claims": 50, "evidence": 100} | (limits or {})
        related: dict[str, Page] = {}
        if "identifiers" in include:
            related["identifiers"] = self.identifiers(id, most["identifiers"])
        if "claims" in include:
            related["claims"] = self._claims_of_all_classes(id, most["claims"])
        if "evidence" in include:
            scope = {"statement": "statement_id", "source": "source_id", "node": "entity_id"}.get(own.role)
            related["evidence"] = self.evidence(**{scope: id}, limit=most["evidence"]) if scope else Page([], most["evidence"], False)
        return {"id": id, "class": own.name, "record": self.store.get(id)["record"], "related": {k: v.rows for k, v in related.items()}, "truncated": {k: v.truncated for k, v in related.items()}, "contract": self.contract.build_digest()}

    def measures(self) -> Page:
        """The accepted measures by name."""
        rows = self.store.heads().filter(F.col("class") == MEASURE).select("record_id", "revision_id", F.from_json("payload", self.store.payload_type(MEASURE)).alias("p"))
        return page(rows.select("record_id", "revision_id", *[F.col(f"p.{n}").alias(n) for n in ("name", "title", "description", "target_class", "expr", "parameters", "dimensions")]), ["name", "record_id"], CAPS["measures"], CAPS["measures"])

    def measure(self, name: str, arguments: dict[str, object] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """The value of an accepted measure over the current records of its class."""
        _, records, own = self._measure(name)
        return measures.evaluate(records, own, arguments, tuple(by))

    def measure_page(self, name: str, arguments: dict[str, object] | None = None, by: tuple[str, ...] = ()) -> tuple[Page, dict[str, str]]:
        """The measure's rows within the cap, and the record and revision of its definition."""
        row, records, own = self._measure(name)
        first, more = measures.evaluate_bounded(records, own, arguments, tuple(by))
        return Page(first.collect(), measures.MAX_ROWS, more.first()["truncated"]), {"id": row["record_id"], "revision_id": row["revision_id"]}

    def _measure(self, name: str) -> tuple[Row, DataFrame, measures.Measure]:
        found = [r for r in self.measures().rows if r["name"] == name]
        if len(found) != 1:
            raise MeasureError(f"{len(found) or 'no'} accepted measures are named {name}", rule="measure_unique" if found else "measure_exists", field="name")
        raw = found[0].asDict()
        raw["parameters"] = json.dumps({p["name"]: p["column"] for p in json.loads(raw["parameters"] or "[]")})
        own = measures.Measure.from_record(raw)
        target = self.contract[own.target_class]
        scalars = [s.name for s in target.slots if not (s.multivalued or s.sensitive) and s.name not in ("id", "created_at", "updated_at")]
        return found[0], self.store.records(own.target_class).select(*scalars), own

    def query(self, operation: str, request: dict | None = None, limit: int | None = None) -> object:
        """One of eight reads by name; members that a read doesn't have are refused."""
        reads: dict[str, tuple[Callable, tuple[str, ...], bool]] = {
            "lookup": (self.lookup, ("namespace", "value", "record_class"), True),
            "identifiers": (self.identifiers, ("id",), True),
            "claims": (self.claims, ("id", "predicate", "include_superseded"), True),
            "evidence": (self.evidence, ("statement_id", "source_id", "support_type"), True),
            "neighbors": (self.neighbors, ("id", "predicate", "direction", "hops", "projection", "max_nodes", "max_edges"), False),
            "traverse": (self.traverse, ("start", "via", "direction", "projection", "max_nodes", "max_edges"), False),
            "unresolved": (self.unresolved, ("record_class", "source_id"), True),
            "integrity": (self.integrity, (), True),
        }
        if operation not in reads:
            raise RecordError(f"no operation {operation}", rule="operation", field="operation")
        read, members, limited = reads[operation]
        if odd := sorted(set(request or {}) - set(members)):
            raise RecordError(f"{operation} has no member {odd[0]}", rule="request_member", field=odd[0])
        return read(**(request or {}), **({"limit": limit} if limited and limit is not None else {}))

    def integrity(self, limit: int = 100) -> Page:
        if self.store.pinned is not None:
            raise SnapshotError("the audit looks at a live store", rule="live_store")
        return page(self.store.audit(), ["issue", "record_id", "revision_id", "batch_id"], limit, CAPS["integrity"])
