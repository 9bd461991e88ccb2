"""Contracts: typed classes compiled from table dictionaries (JSON or YAML) or from a subset of LinkML, and their digests."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError
from ..functions import snake_case, strict_boolean, strict_date, strict_decimal, strict_integer, strict_number, strict_timestamp

SPARK_TYPES = {"string": T.StringType(), "integer": T.LongType(), "decimal": T.DecimalType(18, 3), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "time": T.StringType()}
STRICT: dict[str, Callable[[Column], Column]] = {
    "string": lambda c: c,
    "integer": strict_integer,
    "decimal": strict_decimal,
    "double": strict_number,
    "boolean": strict_boolean,
    "date": strict_date,
    "datetime": strict_timestamp,
    "time": lambda c: F.when(F.trim(c).rlike("^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"), F.trim(c)),
}
#: Names of ranges in both kinds of source; others are classes, enums or unsupported.
RANGES = {"string": "string", "uri": "string", "uriorcurie": "string", "integer": "integer", "decimal": "decimal", "double": "double", "float": "double", "number": "double", "number(quantity)": "double", "number(ordinal)": "double", "boolean": "boolean", "date": "date", "datetime": "datetime", "time": "time"}
#: The class of measure records.
MEASURE = "Measure"
ROLES = ("node", "edge", "statement", "evidence", "source", "mention", "metadata")
POLICIES = ("require", "mint", "resolve_exact", "deterministic")


@dataclass(frozen=True)
class Slot:
    name: str
    type: str = "string"
    required: bool = False
    multivalued: bool = False
    identifier: bool = False
    reference: str | None = None
    enum: tuple[str, ...] = ()
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    namespace: str | None = None
    sensitive: bool = False


@dataclass(frozen=True)
class RecordClass:
    name: str
    slots: tuple[Slot, ...]
    ancestors: tuple[str, ...] = ()
    role: str = "node"
    id_policy: str = "require"
    label_slot: str | None = None
    search_slots: tuple[str, ...] = ()
    origin_slots: tuple[str, ...] = ()

    def slot(self, name: str) -> Slot:
        for s in self.slots:
            if s.name == name:
                return s
        raise ContractError(f"{self.name} has no field {name}", rule="known_field", field=name)

    def struct_type(self) -> T.StructType:
        kind = lambda s: T.ArrayType(SPARK_TYPES[s.type]) if s.multivalued else SPARK_TYPES[s.type]
        return T.StructType([T.StructField(s.name, kind(s), not s.required, {"sensitive": s.sensitive}) for s in self.slots])

    def public_slots(self) -> list[str]:
        return [s.name for s in self.slots if not s.sensitive]

    def content_slots(self) -> list[str]:
        return [s.name for s in self.slots if s.name not in ("id", "created_at", "updated_at")]


@dataclass(frozen=True)
class Contract:
    name: str
    classes: dict[str, RecordClass] = field(default_factory=dict)
    source_digest: str = ""

    def __getitem__(self, name: str) -> RecordClass:
        if name not in self.classes:
            raise ContractError(f"unknown class {name}", rule="known_concrete_class", field=name)
        return self.classes[name]

    def structural_digest(self) -> str:
        """Of what records mean; where the contract came from doesn't count."""
        text = json.dumps({k: asdict(v) for k, v in sorted(self.classes.items())}, sort_keys=True)
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()

    def build_digest(self) -> str:
        return "sha256:" + hashlib.sha256(f"{self.structural_digest()}\x1f{self.source_digest}".encode()).hexdigest()

    def compatible(self, other: Contract) -> bool:
        return self.structural_digest() == other.structural_digest()

    def extends(self, other: Contract) -> bool:
        """Whether every class and slot of the other contract is here as it is there, and what is new may be empty."""
        for name, old in other.classes.items():
            own = self.classes.get(name)
            if own is None or (own.ancestors, own.role, own.id_policy, own.origin_slots) != (old.ancestors, old.role, old.id_policy, old.origin_slots):
                return False
            have = {s.name: s for s in own.slots}
            if any(have.get(s.name) != s for s in old.slots) or any(s.required for s in own.slots if s.name not in {o.name for o in old.slots}):
                return False
        return True

    def measurable(self, but: str) -> dict[str, dict[str, str]]:
        """The scalar public columns of every class but one, with their Spark types."""
        own = lambda c: {s.name: SPARK_TYPES[s.type].simpleString() for s in c.slots if not (s.multivalued or s.sensitive) and s.name not in ("id", "created_at", "updated_at")}
        return {c.name: own(c) for c in self.classes.values() if c.name != but}

    def takes(self, reference: str) -> tuple[str, ...]:
        """Classes that a reference to a class may point to: itself and what descends from it."""
        return tuple(c.name for c in self.classes.values() if reference == c.name or reference in c.ancestors)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "source_digest": self.source_digest, "classes": [asdict(c) for c in self.classes.values()]}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Contract:
        raw = json.loads(text)
        slot = lambda s: Slot(**{**s, "enum": tuple(s["enum"])})
        tupled = ("ancestors", "search_slots", "origin_slots")
        made = [RecordClass(**{**c, **{k: tuple(c[k]) for k in tupled}, "slots": tuple(slot(s) for s in c["slots"])}) for c in raw["classes"]]
        return checked(cls(raw["name"], {c.name: c for c in made}, raw["source_digest"]))


def checked(contract: Contract) -> Contract:
    """The contract, if every class keeps the rules of identity, role, reference and annotation."""

    def require(holds: bool, rule: str, where: str) -> None:
        if not holds:
            raise ContractError(f"{where} breaks {rule}", rule=rule, field=where)

    views: set[str] = set()
    for c in contract.classes.values():
        names = [s.name for s in c.slots]
        ids = [s for s in c.slots if s.identifier]
        require(len(names) == len(set(names)), "unique_field_names", c.name)
        require(len(ids) == 1 and ids[0].name == "id" and ids[0].type == "string" and ids[0].required and not ids[0].multivalued, "class_identifier_contract", c.name)
        require(c.role in ROLES, "class_role_contract", c.name)
        require(c.id_policy in POLICIES and (c.id_policy != "deterministic" or bool(c.origin_slots)), "class_identifier_contract", c.name)
        for s in (*c.search_slots, *c.origin_slots, *([c.label_slot] if c.label_slot else [])):
            require(s in names, "class_annotation_contract", f"{c.name}.{s}")
        for s in (*c.search_slots, *([c.label_slot] if c.label_slot else [])):
            own = c.slot(s)
            require(own.type == "string" and not own.multivalued and not own.sensitive, "class_annotation_contract", f"{c.name}.{s}")
        for s in c.slots:
            require(s.type in SPARK_TYPES, "slot_range_contract", f"{c.name}.{s.name}")
            require(s.reference is None or bool(contract.takes(s.reference)), "slot_range_contract", f"{c.name}.{s.name}")
            require((s.minimum is None and s.maximum is None) or s.type in ("integer", "double"), "slot_bound_contract", f"{c.name}.{s.name}")
            require(len(set(s.enum)) == len(s.enum) and all(v.strip() for v in s.enum), "enum_contract", f"{c.name}.{s.name}")
            require(s.namespace is None or (s.type == "string" and not s.sensitive and s.reference is None), "external_identifier_contract", f"{c.name}.{s.name}")
        view = snake_case(c.name)
        require(view not in views, "projection_name_contract", c.name)
        views.add(view)
    return contract


def _load(text: str) -> dict:
    if text.lstrip().startswith("{"):

        def unique(pairs: list) -> dict:
            if len({k for k, _ in pairs}) != len(pairs):
                raise ContractError("a key occurs twice", rule="duplicate_key")
            return dict(pairs)

        def safe(token: str) -> float:
            """Numbers that a double holds as they are written; larger ones must be texts."""
            value, lost = float(token), re.search("[1-9]", re.split("[eE]", token)[0])
            if (value == 0 and lost) or math.isinf(value) or abs(Decimal(token)) > 2**53 - 1:
                raise ContractError(f"the number {token} isn't safe", rule="unsafe_json_number")
            return value

        return json.loads(text, object_pairs_hook=unique, parse_float=safe, parse_int=lambda token: int(token) if safe(token) is not None else None)
    try:
        import yaml
    except ImportError as e:
        raise ContractError("YAML contracts need a YAML library", rule="yaml_library") from e
    return yaml.safe_load(text)


def read_contract(spark: SparkSession, path: str, **options) -> Contract:
    """A contract from a file, by what the file is: a written contract (`.contract.json`), a table dictionary (`.json`, or YAML with tables),
    or LinkML (YAML with classes). Imports of a LinkML file are files beside it. options: those of from_linkml."""
    folder, _, name = path.rpartition("/")
    if not re.search(r"\.(json|ya?ml)$", name.lower()):
        raise ContractError(f"{path} is neither .json nor .yaml", rule="schema_extension", field="path")

    def text_at(at: str) -> str:
        found = spark.read.text(at, wholetext=True).collect()
        return "".join(r["value"] for r in found)  # one file

    text = text_at(path)
    if name.lower().endswith(".contract.json"):
        return Contract.from_json(text)
    raw = _load(text)
    if not isinstance(raw, dict) or not ("tables" in raw) ^ ("classes" in raw or "imports" in raw):
        raise ContractError(f"{path} has neither tables nor classes, or both", rule="schema_kind", field="path")
    if "tables" in raw:
        return from_table_dictionary(text)
    return from_linkml(text, resolve=lambda other: text_at(f"{folder}/{other}.yaml"), **options)


#: What a public copy of a dictionary leaves out, of the whole, of tables and of columns: where data comes from, and values of it.
_PRIVATE = {"document": ("origin",), "table": ("origin", "source"), "column": ("examples", "range")}


def public_dictionary(text: str) -> dict:
    """A table dictionary without what tells of its data: origins and sources, and examples and ranges of columns at any depth."""

    def column(own: dict) -> dict:
        left = {k: v for k, v in own.items() if k not in _PRIVATE["column"]}
        return left | {"fields": [column(c) for c in own["fields"]]} if isinstance(own.get("fields"), list) else left

    raw = _load(text)
    tables = [{k: v for k, v in t.items() if k not in _PRIVATE["table"]} | {"columns": [column(c) for c in t["columns"]]} for t in raw["tables"]]
    return {k: v for k, v in raw.items() if k not in _PRIVATE["document"]} | {"tables": tables}


def measure_definitions(text: str) -> list[dict[str, str | None]]:
    """The measures that a table dictionary defines beside its tables, as measure records."""
    raw, out = _load(text), []
    for table in raw["tables"]:
        for d in table.get("definitions") or []:
            own = {"id": f"measure:{d['name']}", "name": d["name"], "title": d.get("label"), "description": d.get("description"), "target_class": table["name"], "expr": d["expr"]}
            out.append(own | {"parameters": "[]", "dimensions": "[]"})
    return out


def from_table_dictionary(text: str) -> Contract:
    """A contract from a table dictionary: one class of role node for each table, scalar foreign keys to `id`."""
    raw = _load(text)
    classes = {}
    for table in raw["tables"]:
        slots = []
        for c in table["columns"]:
            kind, many, rules = c["type"], False, set(c.get("constraints") or [])
            if kind.startswith("list(") and kind.endswith(")"):
                kind, many = kind[5:-1], True
            where = f"{table['name']}.{c['name']}"
            if kind != "enum" and kind not in RANGES:
                raise ContractError(f"{where} has the unsupported type {c['type']}", rule="supported_type", field=where)
            target = c.get("references")
            if target and target["column"] != "id":
                raise ContractError(f"{where} refers to a column that isn't id", rule="reference_column", field=where)
            numeric = RANGES.get(kind) in ("integer", "double")
            bounds = (c.get("range") or {}) if numeric else {}
            slots.append(
                Slot(
                    c["name"], RANGES.get(kind, "string"), bool(rules & {"required", "primary_key"}), many, "primary_key" in rules,
                    target["table"] if target else None, tuple(c.get("values") or ()) if kind == "enum" else (), None, bounds.get("min"), bounds.get("max"), None, c.get("display") == "restricted",
                )
            )
        searchable = [s.name for s in slots if s.type == "string" and not (s.identifier or s.reference or s.enum or s.multivalued or s.sensitive)]
        classes[table["name"]] = RecordClass(table["name"], tuple(slots), (table["name"],), "node", "require", searchable[0] if searchable else None, tuple(searchable))
    return checked(Contract(raw["name"], classes, "sha256:" + hashlib.sha256(text.encode()).hexdigest()))


#: What the LinkML subset reads, and what only describes. Anything else that is set would change what records mean, so it is refused.
_DESCRIBES = ("name", "description", "title", "annotations", "comments", "notes", "examples", "aliases", "see_also", "todos", "source", "in_language", "rank", "keywords", "contributors", "created_by", "created_on", "last_updated_on", "modified_by", "status", "in_subset", "from_schema", "deprecated", "exact_mappings", "close_mappings", "related_mappings", "narrow_mappings", "broad_mappings", "mappings", "local_names", "alt_descriptions", "conforms_to", "definition_uri", "categories", "structured_aliases", "extensions")
_READS = {
    "schema": ("id", "version", "license", "prefixes", "default_prefix", "default_range", "default_curi_maps", "emit_prefixes", "imports", "classes", "slots", "enums", "types", "subsets", "settings", "metamodel_version", "source_file", "source_file_date", "source_file_size", "generation_date"),
    "class": ("is_a", "abstract", "slots", "attributes", "slot_usage", "class_uri", "mixin", "mixins"),
    "slot": ("range", "required", "multivalued", "identifier", "pattern", "minimum_value", "maximum_value", "slot_uri", "inlined", "inlined_as_list", "alias", "owner", "domain_of"),
    "enum": ("permissible_values",),
    "value": ("text", "meaning"),
}


def _refuse(kind: str, where: str, spec: dict | None) -> None:
    """An error for the first thing that an element sets and the subset doesn't have."""
    for key, value in (spec or {}).items():
        is_set = value is not None and value is not False and value != {} and value != []
        if is_set and (key not in (*_DESCRIBES, *_READS[kind]) or (kind, key) in (("class", "mixins"), ("class", "mixin"), ("schema", "types"))):
            raise ContractError(f"{where} uses {key}", rule="supported_linkml", field=key)


def _closure(text: str, resolve: Callable[[str], str] | None) -> tuple[dict, list[tuple[str, str]]]:
    """The schema of a text with all that it imports, each once, and the imported texts by name. What is nearer to the text wins;
    `linkml:types` stands for the ranges that are known anyway. A schema that imports itself over others is an error."""
    merged: dict[str, dict] = {"classes": {}, "slots": {}, "enums": {}}
    seen: dict[str, str] = {}

    def visit(own: str, raw: dict, above: tuple[str, ...]) -> None:
        _refuse("schema", f"schema {raw.get('name', own)}", raw)
        for part, of in merged.items():
            for name, spec in (raw.get(part) or {}).items():
                if name in of and of[name] != spec and own:
                    raise ContractError(f"{name} is defined in several schemas", rule="unique_import_names", field=name)
                of.setdefault(name, spec)
        for name in raw.get("imports") or []:
            if name in above:
                raise ContractError(f"{name} imports itself", rule="import_cycle", field=name)
            if name == "linkml:types" or name in seen:
                continue
            if resolve is None:
                raise ContractError(f"the import {name} can't be resolved", rule="import_exists", field=name)
            seen[name] = resolve(name)
            visit(name, _load(seen[name]), (*above, name))

    top = _load(text)
    visit("", top, ())
    return {**top, **merged}, sorted(seen.items())


def from_linkml(text: str, core: str | None = None, prefix: str | None = None, resolve: Callable[[str], str] | None = None) -> Contract:
    """A contract from the supported LinkML subset. Annotations `<prefix>.<name>` set role, id_policy, label_slot,
    search_slots, origin_key_slots, external_identifier and sensitive; classes of `core` are inherited from. resolve gives the text of an
    imported schema by its name; concrete classes of imported schemas are classes of the contract, and the digest of the source covers all texts."""
    (raw, imported), base = _closure(text, resolve), _load(core) if core else {}
    every = {**(base.get("classes") or {}), **(raw.get("classes") or {})}
    slot_defs = {**(base.get("slots") or {}), **(raw.get("slots") or {})}
    enums = {**(base.get("enums") or {}), **(raw.get("enums") or {})}

    def note(owner: dict, name: str) -> str | None:
        for key, value in (owner.get("annotations") or {}).items():
            if key == name or (key.endswith(f".{name}") and (prefix is None or key == f"{prefix}.{name}")):
                return str(value["value"] if isinstance(value, dict) else value)
        return None

    def line(name: str) -> list[str]:
        out = []
        while name:
            if name in out or name not in every:
                raise ContractError(f"{name} has no consistent ancestors", rule="class_hierarchy_contract", field=name)
            out.append(name)
            name = (every[name] or {}).get("is_a")
        return out

    for kind, defs in (("class", every), ("slot", slot_defs), ("enum", enums)):
        for name, spec in defs.items():
            _refuse(kind, name, spec)
    for name, spec in enums.items():
        for value, own in ((spec or {}).get("permissible_values") or {}).items():
            _refuse("value", f"{name}.{value}", own)

    def made(owner: str, name: str, spec: dict) -> Slot:
        _refuse("slot", f"{owner}.{name}", spec)
        kind = spec.get("range") or raw.get("default_range") or "string"
        values = tuple((enums[kind].get("permissible_values") or {})) if kind in enums else ()
        if spec.get("inlined"):
            raise ContractError(f"{owner}.{name} is inlined", rule="supported_linkml", field=name)
        if kind not in RANGES and kind not in enums and kind not in every:
            raise ContractError(f"{owner}.{name} has the unknown range {kind}", rule="slot_range_contract", field=name)
        identifier = bool(spec.get("identifier"))
        return Slot(
            name, RANGES.get(kind, "string"), bool(spec.get("required")) or identifier, bool(spec.get("multivalued")), identifier, kind if kind in every else None, values,
            spec.get("pattern"), spec.get("minimum_value"), spec.get("maximum_value"), note(spec, "external_identifier"), note(spec, "sensitive") in ("True", "true"),
        )

    classes = {}
    for name, own in (raw.get("classes") or {}).items():
        own = own or {}
        if own.get("abstract"):
            continue
        ancestors, specs = line(name), {}
        for c in reversed(ancestors):
            for s in every[c].get("slots") or []:
                specs[s] = {**(slot_defs.get(s) or {}), **specs.get(s, {})}
            for s, spec in (every[c].get("attributes") or {}).items():
                specs[s] = {**specs.get(s, {}), **(spec or {})}
            for s, spec in (every[c].get("slot_usage") or {}).items():
                specs[s] = {**specs.get(s, {}), **(spec or {})}
        slots = tuple(made(name, s, spec) for s, spec in specs.items())
        up = lambda key, default: next((v for c in ancestors if (v := note(every[c] or {}, key))), default)  # noqa: B023, E731
        listed = lambda key: tuple(x.strip() for x in (up(key, "") or "").split(",") if x.strip())  # noqa: B023, E731
        texts = [s.name for s in slots if s.type == "string" and not (s.identifier or s.reference or s.enum or s.multivalued or s.sensitive)]
        classes[name] = RecordClass(name, slots, tuple(ancestors), up("role", "node"), up("id_policy", "require"), up("label_slot", texts[0] if texts else None), listed("search_slots") or tuple(texts), listed("origin_key_slots"))
    all_names = {a for c in classes.values() for a in c.ancestors}
    for c in classes.values():
        for s in c.slots:
            if s.reference and s.reference not in all_names:
                raise ContractError(f"{c.name}.{s.name} refers to a class without records", rule="slot_range_contract", field=s.name)
    sources = text if not imported else json.dumps([text, *imported])
    return checked(Contract(raw["name"], classes, "sha256:" + hashlib.sha256(sources.encode()).hexdigest()))
