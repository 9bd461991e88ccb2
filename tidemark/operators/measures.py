"""Reviewed aggregate measures: named expressions over a class, read into a tree of typed columns and evaluated by Spark.

An expression may use the columns it is given, numbers, text in single quotes (a quote in it is doubled), TRUE and FALSE, arithmetic,
one comparison at a time, NOT, AND, OR, parentheses, and the aggregates SUM, COUNT, AVG, MIN and MAX, DISTINCT inside COUNT
alone. Its rules are checked while the tree is made: operands have kinds (number, boolean, text, time) that their operators take, aggregates
aren't nested, and a column stands inside an aggregate. Booleans are summed as 0 and 1; division by zero gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MeasureError
from .ledger import bounded

#: Aggregates with their functions, in the spelling of the language.
AGGREGATES: dict[str, Callable[[Column], Column]] = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
#: Most rows that one evaluation by dimensions gives.
MAX_ROWS = 1000
_LEXEME = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<text>'(?:[^']|'')*')|(?P<name>[A-Za-z_]\w*)|(?P<op>!=|<=|>=|[=<>+*/(),-]))")
#: How tightly binary operators bind; comparisons take no comparison beside them.
_BINDS = {"OR": 1, "AND": 2, "=": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6}
_NOT, _COMPARE, _SIGN = 3, 4, 7
NUMBER, BOOLEAN, TEXT, TIME = "number", "boolean", "text", "time"


class _Unreadable(Exception):
    pass


@dataclass(frozen=True)
class Term:
    """A part of an expression: what makes its column, its kind (None after an issue), whether it holds a bare column or an aggregate."""

    value: Callable[[], Column]
    kind: str | None
    bare: bool = False
    aggregate: bool = False


def kind_of(spark_type: str) -> str:
    if spark_type == "boolean":
        return BOOLEAN
    if spark_type.startswith(("date", "timestamp", "interval")):
        return TIME
    return NUMBER if re.match(r"(tinyint|smallint|int|bigint|float|double|decimal)", spark_type) else TEXT


class _Reader:
    """Reads one expression by the binding of its operators, noting the rules that it breaks."""

    def __init__(self, expression: str, types: dict[str, str]):
        self.types, self.at, self.broken = types, 0, []
        self.lexemes: list[tuple[str, str]] = []
        place, stripped = 0, expression.rstrip()
        while place < len(stripped):
            m = _LEXEME.match(stripped, place)
            if not m:
                raise _Unreadable
            self.lexemes.append((m.lastgroup, m[m.lastgroup]))
            place = m.end()
        self.lexemes.append(("end", ""))

    def note(self, rule: str) -> None:
        if rule not in self.broken:
            self.broken.append(rule)

    def operator(self) -> str:
        """The operator or keyword at this place in capitals; other lexemes have none."""
        kind, text = self.lexemes[self.at]
        return text.upper() if kind in ("op", "name") else ""

    def take(self, text: str) -> None:
        if self.operator() != text:
            raise _Unreadable
        self.at += 1

    def whole(self) -> Term:
        out = self.expression(0)
        if self.lexemes[self.at][0] != "end":
            raise _Unreadable
        if out.bare or not out.aggregate:
            self.note("measure_expr_aggregate")
        return out

    def expression(self, above: int) -> Term:
        left = self.operand()
        while (binds := _BINDS.get(self.operator(), 0)) > above:
            op = self.operator()
            self.at += 1
            left = self.combined(op, left, self.expression(binds))
            if binds == _COMPARE:  # no second comparison at this level
                above = max(above, _COMPARE) if _BINDS.get(self.operator()) == _COMPARE else above
        return left

    def operand(self) -> Term:
        kind, text = self.lexemes[self.at]
        self.at += 1
        if kind == "number":
            return Term(lambda: F.lit(float(text)) if "." in text else F.lit(int(text)), NUMBER)
        if kind == "text":
            return Term(lambda: F.lit(text[1:-1].replace("''", "'")), TEXT)
        if text == "(":
            inner = self.expression(0)
            self.take(")")
            return inner
        if text == "-":
            inner = self.expression(_SIGN)
            return self.typed(inner, (NUMBER,), lambda: -inner.value(), NUMBER)
        if kind != "name":
            raise _Unreadable
        if text.upper() == "NOT":
            inner = self.expression(_NOT)
            return self.typed(inner, (BOOLEAN,), lambda: ~inner.value(), BOOLEAN)
        if text.upper() in ("TRUE", "FALSE"):
            return Term(lambda: F.lit(text.upper() == "TRUE"), BOOLEAN)
        if self.operator() == "(":
            return self.call(text.upper())
        if text not in self.types:
            self.note("measure_expr_column")
            return Term(lambda: F.lit(None), None, bare=True)
        return Term(lambda: F.col(f"`{text}`"), kind_of(self.types[text]), bare=True)

    def call(self, name: str) -> Term:
        self.take("(")
        if name not in AGGREGATES:
            self.note("measure_expr_function")
        distinct = False
        if name == "COUNT" and self.operator() == "*":
            self.at += 1
            inner = Term(lambda: F.lit(1), NUMBER)
        else:
            if distinct := self.operator() == "DISTINCT":
                self.at += 1
                if name != "COUNT":
                    self.note("measure_expr_distinct")
            inner = self.expression(0)
        self.take(")")
        if inner.aggregate:
            self.note("measure_expr_nested")
        if name in ("SUM", "AVG") and inner.kind not in (NUMBER, BOOLEAN, None):
            self.note("measure_expr_type")

        def made() -> Column:
            own = inner.value().cast("int") if inner.kind == BOOLEAN and name in ("SUM", "AVG") else inner.value()
            return F.count_distinct(own) if distinct else AGGREGATES[name](own)

        return Term(made, inner.kind if name in ("MIN", "MAX") else NUMBER, aggregate=True)

    def typed(self, inner: Term, takes: tuple[str, ...], value: Callable[[], Column], kind: str) -> Term:
        if inner.kind is not None and inner.kind not in takes:
            self.note("measure_expr_type")
        return Term(value, kind, inner.bare, inner.aggregate)

    def combined(self, op: str, a: Term, b: Term) -> Term:
        x, y = a.value, b.value
        if op in ("AND", "OR"):
            takes, kind, value = (BOOLEAN,), BOOLEAN, (lambda: x() & y()) if op == "AND" else (lambda: x() | y())
        elif op in ("+", "-", "*", "/"):
            made = {"+": lambda: x() + y(), "-": lambda: x() - y(), "*": lambda: x() * y(), "/": lambda: x() / F.nullif(y(), F.lit(0))}
            takes, kind, value = (NUMBER,), NUMBER, made[op]
        else:
            made = {"=": lambda: x() == y(), "!=": lambda: x() != y(), "<": lambda: x() < y(), "<=": lambda: x() <= y(), ">": lambda: x() > y(), ">=": lambda: x() >= y()}
            takes, kind, value = (a.kind or b.kind or TEXT,), BOOLEAN, made[op]
            if TIME in (a.kind, b.kind) and TEXT in (a.kind, b.kind):  # a time beside its text
                takes = (TIME, TEXT)
        for side in (a, b):
            if side.kind is not None and side.kind not in takes:
                self.note("measure_expr_type")
        return Term(value, kind, a.bare or b.bare, a.aggregate or b.aggregate)


def read(expression: str, types: dict[str, str]) -> tuple[Callable[[], Column] | None, list[str]]:
    """What makes the column of an expression over columns of these types, None where it breaks rules; and the rules."""
    reader = None
    try:
        reader = _Reader(expression, types)
        term = reader.whole()
    except _Unreadable:
        return None, [*(reader.broken if reader else []), "measure_expr_parse"]
    return (None if reader.broken else term.value), reader.broken


def issues(expression: str, columns: list[str] | dict[str, str]) -> list[str]:
    """The rules that an expression breaks; without types of the columns, those of types aren't looked at."""
    typed = isinstance(columns, dict)
    found = read(expression, columns if typed else dict.fromkeys(columns, "double"))[1]
    return found if typed else [r for r in found if r != "measure_expr_type"]


def column(expression: str, types: dict[str, str]) -> Column:
    """The expression as a column."""
    made, broken = read(expression, types)
    if broken:
        raise MeasureError(f"measure expression breaks {', '.join(broken)}", rule=broken[0], field="expr")
    return made()


#: What every parameter of a definition must say.
PARAMETER = ("name", "type", "description", "column")


def definition_issues(row: dict, classes: dict[str, dict[str, str]]) -> list[tuple[str, str]]:
    """field and rule of what is wrong in a measure's record; classes: the scalar columns of each measurable class, with their types."""
    target = row.get("target_class")
    if target is None:
        return []  # a required field, so an issue already
    if target not in classes:
        return [("target_class", "measure_target_class")]
    columns = classes[target]
    out = [("expr", rule) for rule in issues(row["expr"], columns)] if row.get("expr") else []
    parameters, dimensions = _list(row.get("parameters")), _list(row.get("dimensions"))
    if parameters is None:
        out.append(("parameters", "measure_parameter_json"))
    for p in parameters or []:
        if not (isinstance(p, dict) and all(isinstance(p.get(k), str) and p[k] for k in PARAMETER)):
            out.append(("parameters", "measure_parameter_contract"))
        elif p["column"] not in columns:
            out.append(("parameters", "measure_parameter_column"))
    if dimensions is None:
        out.append(("dimensions", "measure_dimension_json"))
    for d in dimensions or []:
        if not isinstance(d, str) or d not in columns:
            out.append(("dimensions", "measure_dimension_column"))
    return sorted(set(out))


def _list(text: str | None) -> list | None:
    """A JSON array, empty for no text; None where it is something else."""
    try:
        found = json.loads(text) if text else []
    except ValueError:
        return None
    return found if isinstance(found, list) else None


@dataclass(frozen=True)
class Measure:
    name: str
    target_class: str
    expr: str
    title: str = ""
    parameters: dict[str, str] = field(default_factory=dict)  # name: column
    dimensions: tuple[str, ...] = ()

    @classmethod
    def from_record(cls, row: dict) -> Measure:
        return cls(row["name"], row["target_class"], row["expr"], row.get("title") or "", json.loads(row.get("parameters") or "{}"), tuple(json.loads(row.get("dimensions") or "[]")))


def _evaluated(records: DataFrame, measure: Measure, arguments: dict[str, object] | None, by: tuple[str, ...]) -> DataFrame:
    types = dict(records.dtypes)
    for name, value in (arguments or {}).items():
        if name not in measure.parameters:
            raise MeasureError(f"{name} is no parameter of {measure.name}", rule="measure_argument", field=name)
        records = records.filter(F.col(measure.parameters[name]) == F.lit(value))
    if odd := [d for d in by if d not in measure.dimensions]:
        raise MeasureError(f"{odd[0]} is no dimension of {measure.name}", rule="measure_dimension", field=odd[0])
    value = column(measure.expr, types).alias("value")
    return records.groupBy(*by).agg(value) if by else records.agg(value)


def evaluate(records: DataFrame, measure: Measure, arguments: dict[str, object] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The measure's value, for each group of the dimensions in `by`, over the records that the arguments select.

    By dimensions, the first MAX_ROWS groups come back, in the order of the dimensions; nulls are last. `evaluate_bounded` also says whether there were more.
    """
    out = _evaluated(records, measure, arguments, by)
    return out.orderBy(*[F.asc_nulls_last(d) for d in by]).limit(MAX_ROWS) if by else out


def evaluate_bounded(records: DataFrame, measure: Measure, arguments: dict[str, object] | None = None, by: tuple[str, ...] = (), most: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """The first `most` groups, and one row that says whether there were more (`truncated`)."""
    return bounded(_evaluated(records, measure, arguments, by), [F.asc_nulls_last(d) for d in by or ("value",)], most)
