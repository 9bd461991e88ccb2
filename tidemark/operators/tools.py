"""Bounded read-only tools over a store or a pinned view: JSON schemas of their arguments, limits, and a receipt with each answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..errors import LimitError, RecordError
from ..sources.knowledge import CAPS, Knowledge, Subgraph
from ..sources.store import Store

#: Rows that an answer holds at most.
MOST = 1000
OPERATIONS = ("lookup", "identifiers", "claims", "evidence", "neighbors", "traverse", "unresolved", "integrity")


@dataclass(frozen=True)
class Tool:
    """A read. `arguments` maps each argument to its JSON schema; `required` names those that a call must have. Tools change nothing."""

    name: str
    description: str
    arguments: dict[str, dict]
    run: Callable[..., dict]
    required: tuple[str, ...] = ()

    def schema(self) -> dict:
        """The closed JSON schema of the arguments."""
        return {"type": "object", "properties": self.arguments, "required": list(self.required), "additionalProperties": False}

    def __call__(self, **arguments) -> dict:
        if odd := [a for a in arguments if a not in self.arguments]:
            raise RecordError(f"{self.name} has no argument {odd[0]}", rule="known_argument", field=odd[0])
        if lost := [a for a in self.required if a not in arguments]:
            raise RecordError(f"{self.name} needs {lost[0]}", rule="required_argument", field=lost[0])
        for name, value in arguments.items():
            check(self.arguments[name], value, name)
        return self.run(**arguments)


_TYPES = {"string": str, "integer": int, "array": (list, tuple), "object": dict, "boolean": bool}


def check(schema: dict, value: object, where: str) -> None:
    """An error where a value isn't what its schema says: type, enum, bounds, items and members."""
    kind = _TYPES.get(schema.get("type", ""))
    if kind and (not isinstance(value, kind) or (schema["type"] == "integer" and isinstance(value, bool))):
        raise RecordError(f"{where} isn't of type {schema['type']}", rule="argument_type", field=where)
    if "enum" in schema and value not in schema["enum"]:
        raise RecordError(f"{where} is none of {', '.join(map(str, schema['enum']))}", rule="argument_enum", field=where)
    if schema.get("type") == "integer" and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        raise LimitError(f"{where} must be {schema['minimum']} to {schema['maximum']}", rule="limit", field=where)
    for item in value if schema.get("type") == "array" and "items" in schema else ():
        check(schema["items"], item, where)
    if schema.get("type") == "object" and "properties" in schema:
        for name, member in value.items():
            if name not in schema["properties"]:
                raise RecordError(f"{where} has no member {name}", rule="known_argument", field=f"{where}.{name}")
            check(schema["properties"][name], member, f"{where}.{name}")


def _text(description: str, **more) -> dict:
    return {"type": "string", "description": description} | more


def _limit(most: int) -> dict:
    return {"type": "integer", "minimum": 1, "maximum": most, "description": "Most rows of the answer."}


def receipt(store: Store) -> dict:
    """What an answer rests on: the store, its boundary, the digest of its log there, and its contract."""
    at = store.snapshot()
    boundary = {"kind": "live" if store.pinned is None else "snapshot", "commit_order": at.commit_order, "batch_id": at.batch_id, "digest": at.digest}
    return {"store": at.path, "boundary": boundary, "contract": store.contract.build_digest()}


def tools(store: Store) -> dict[str, Tool]:
    known = Knowledge(store)

    def answered(rows: list, limit: int, truncated: bool, at: dict | None = None) -> dict:
        return {"rows": [r.asDict(recursive=True) for r in rows], "limit": limit, "truncated": truncated, "receipt": at or receipt(store)}

    def find(query: str, record_class: str | None = None, limit: int = 20) -> dict:
        found = known.find(query, record_class, limit)
        out = answered(found.rows, found.limit, found.truncated)
        return out | {"rows": [{"record_id": r["id"], **r} for r in out["rows"]]}

    def get(id: str, include: tuple[str, ...] = ("identifiers", "claims", "evidence"), limits: dict[str, int] | None = None) -> dict:  # noqa: A002
        found = known.get(id, tuple(include), limits)
        related = {k: [r.asDict(recursive=True) for r in v] for k, v in found["related"].items()}
        return found | {"related": related, "any_truncated": any(found["truncated"].values()), "receipt": receipt(store)}

    def query(operation: str, request: dict | None = None, limit: int | None = None) -> dict:
        found = known.query(operation, request, limit)
        if isinstance(found, Subgraph):
            graph = {k: [r.asDict() for r in v] for k, v in (("nodes", found.nodes), ("edges", found.edges))}
            return graph | {"truncated": found.truncated, "receipt": receipt(store)}
        return answered(found.rows, found.limit, found.truncated)

    def history(id: str, as_of: str | None = None, limit: int = 100) -> dict:  # noqa: A002
        at = receipt(store)
        if as_of is not None:
            at["boundary"] = {"kind": "history", "commit_order": store.boundary(as_of), "as_of": as_of}
        rows = store.history(id, as_of).select("revision_number", "commit_order", "operation", "batch_id").limit(limit + 1).collect()
        return answered(rows[:limit], limit, len(rows) > limit, at)

    def lookup(namespace: str, value: str, limit: int = 20) -> dict:
        from .search import lookup as by_identifier

        wanted = store.spark.createDataFrame([(namespace, value)], "namespace string, value string")
        rows = by_identifier(store.identifiers(), wanted).select("class", "record_id", "status").orderBy(F.asc("class"), F.asc("record_id")).limit(limit + 1).collect()
        return answered(rows[:limit], limit, len(rows) > limit)

    def measure(name: str, arguments: dict | None = None, by: tuple[str, ...] = ()) -> dict:
        found, definition = known.measure_page(name, arguments, tuple(by))
        return answered(found.rows, found.limit, found.truncated, receipt(store) | {"definition": definition})

    record = _text("Id of a record.")
    related = {"type": "object", "properties": {k: _limit(CAPS[k]) for k in ("identifiers", "claims", "evidence")}, "additionalProperties": False, "description": "Most rows of each related part."}
    included = {"type": "array", "items": {"type": "string", "enum": ["identifiers", "claims", "evidence"]}, "description": "Related parts of the answer."}
    operations = [o for o in OPERATIONS if o != "integrity" or store.pinned is None]
    request = {"type": "object", "description": "Members of the operation; others are refused."}
    made = [
        Tool("find", "Records whose label or searched fields contain a text; by class and id.", {"query": _text("Text to look for."), "record_class": _text("Only records of this class.", enum=sorted(store.contract.classes)), "limit": _limit(MOST)}, find, ("query",)),
        Tool("get", "One record with its identifiers, the claims about it and their evidence.", {"id": record, "include": included, "limits": related}, get, ("id",)),
        Tool("query", "One of the bounded reads by name.", {"operation": _text("The read.", enum=operations), "request": request, "limit": _limit(max(CAPS.values()))}, query, ("operation",)),
        Tool("history", "Revisions of a record, newest first, up to a batch or a time.", {"id": record, "as_of": _text("A committed batch or a time."), "limit": _limit(MOST)}, history, ("id",)),
        Tool("lookup", "Records that an external identifier stands for.", {"namespace": _text("Namespace of the identifier."), "value": _text("The identifier, in any spelling."), "limit": _limit(MOST)}, lookup, ("namespace", "value")),
    ]
    if known.measured and (names := [m["name"] for m in known.measures().rows]):
        by = {"type": "array", "items": {"type": "string"}, "description": "Declared dimensions to group by."}
        made.append(Tool("measure", "The value of an accepted measure; arguments are equality filters on its parameters.", {"name": _text("An accepted measure.", enum=sorted(names)), "arguments": {"type": "object", "description": "Values of declared parameters."}, "by": by}, measure, ("name",)))
    return {t.name: t for t in made}
