"""Validation rules of candidate records as columns, and checks across records as joins; every finding is a row of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = ("class", "record_id", "field", "rule")


def missing(value: Column) -> Column:
    """Null or, as text, blank."""
    return value.isNull() | (F.trim(value.cast("string")) == "")


def rules_for(slot) -> list[tuple[str, Column]]:
    """(rule, broken) for one slot of a contract over the raw text column of its name."""
    from ..sources.contract import STRICT

    value, out = F.col(slot.name), []
    absent = missing(value)
    if slot.multivalued:
        absent = value.isNull() | (F.size(value) == 0)
        out.append(("non_missing_collection_values", F.exists(value, lambda x: missing(x))))
        if slot.enum:
            out.append(("enum_membership", F.exists(value, lambda x: ~missing(x) & ~x.isin(*slot.enum))))
    if slot.required:
        out.append(("required", absent))
    if slot.multivalued:
        return out
    typed = STRICT[slot.type](value.cast("string"))
    if slot.type != "string":
        out.append((f"type_{slot.type}", ~absent & typed.isNull()))
    if slot.enum:
        out.append(("enum_membership", ~absent & ~value.isin(*slot.enum)))
    if slot.pattern:
        out.append(("pattern", ~absent & ~value.rlike(slot.pattern)))
    if slot.minimum is not None:
        out.append(("minimum_value", ~absent & (typed < slot.minimum)))
    if slot.maximum is not None:
        out.append(("maximum_value", ~absent & (typed > slot.maximum)))
    return out


def issues(records: DataFrame, record_class: str | Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """A row for each record and (field, rule, broken column) that it breaks, in one pass."""
    own = F.lit(record_class) if isinstance(record_class, str) else record_class
    each = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"))) for f, r, b in rules]))
    return records.select(own.alias("class"), "record_id", F.explode(each).alias("x")).select("class", "record_id", "x.field", "x.rule")


def exactly_one(a: str, b: str) -> Column:
    return F.col(a).isNull() == F.col(b).isNull()


def duplicates(records: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that more than one record has."""
    return records.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").withColumn("rule", F.lit(rule))


def references(records: DataFrame, targets: DataFrame, slots: dict[str, tuple[str, ...]]) -> DataFrame:
    """Issues of references: a target that no record has, or one of a class that the slot doesn't take.

    targets: record_id, class and ancestors; slots: for each reference column the classes it takes (none: any).
    """
    each = [records.select("class", "record_id", F.lit(s).alias("field"), F.col(s).alias("target")) for s in slots]
    refs = reduce(DataFrame.unionByName, each).filter("target is not null")
    known = targets.select(F.col("record_id").alias("target"), F.col("class").alias("target_class"))
    joined = refs.join(known, "target", "left")
    takes = F.lit(True)
    for s, classes in slots.items():
        if classes:
            takes = F.when(F.col("field") == s, F.col("target_class").isin(*classes)).otherwise(takes)
    rule = F.when(F.col("target_class").isNull(), "reference_exists").when(~takes, "reference_class")
    return joined.withColumn("rule", rule).filter("rule is not null").select("class", "record_id", "field", "target", "rule")
