"""Quality rules as learned decision lists, in DataFrame functions only.

Every document gets statistics of its whole text. Sequential covering then learns an ordered list of rules for bad
documents from labelled ones: a rule grows by the threshold condition with the best information gain on the growing part,
loses its last conditions again while that doesn't hurt on the pruning part, and is taken if it is precise there; rows it
covers leave both parts. All counts come from aggregations over the labelled rows; thresholds are quantiles of their
statistics. The list is emitted as one ordered Spark conditional.

Defined results: null text counts as empty (all statistics 0, base_failed); without labels of both kinds no rule is
learned; ties between conditions go to the first statistic, direction and threshold in order; repeated rows give repeated
rows; other columns stay, and input columns named like an added one are replaced. A label on a document that occurs more
than once counts for each row; a document with several labels counts for each of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, shielded, text_of, without

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_upper", "n_distinct_words")
#: What rules may test.
FEATURES = ("n_words", "symbols_per_word", "dup_line_share", "repeat_share", "word_length", "upper_share", "distinct_share", "words_per_line")
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


@dataclass(frozen=True)
class Limits:
    """Where learning stops: thresholds tried for each statistic, rules, conditions of a rule, and what a rule must reach."""

    quantiles: int = 31
    rules: int = 8
    conditions: int = 3
    precision: float = 0.8
    support: int = 5


class Rules(list):
    """An ordered list of rules, and why it ended: `no gain`, `imprecise`, or `limit` where further rules were left unlearned."""

    stopped: str = "no gain"


def repeated_words(words: Column, hashes: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more: windows are sorted by hash, equal neighbours compared."""
    mask = F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double") + 1))).cast("long") - 1, F.lit(0).cast("long"))
    at = lambda i: F.get(hashes, i)
    window = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

    def same(x: Column, y: Column) -> Column:
        p, q = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
        words_equal = (at(p) == at(q)) & (at(p + 1) == at(q + 1)) & (at(p + 2) == at(q + 2))
        return F.coalesce((x.bitwiseXOR(y) <= mask) & (x.bitwiseXOR(y) >= 0) & words_equal, F.lit(False))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))
        return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))

    def covered(p: Column) -> Column:
        widths = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1), x + 3) - x))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    # each array is bound once: the one element of a singleton array is a lambda's argument
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return F.when(n >= 4, once(once(packed, starts), covered)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts of COUNTS."""
    text = F.col("__text")
    chars = F.length(text)
    nonblank = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    names = [*COUNTS, "__text", "__words", "__lines", "__hashes", "__n"]
    step = without(docs, *names).withColumn("__text", text_of(F.col(f"`{text_col}`")))
    step = step.withColumns({"__words": F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != ""), "__lines": nonblank})
    step = step.withColumns({"__hashes": F.transform("__words", lambda x: F.xxhash64(x)), "__n": F.size("__words")})
    none = F.lit(0).cast("long")
    found = {
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (chars - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(repeated_words(F.col("__words"), F.col("__hashes"), F.col("__n")), none),
        "n_lines": F.size("__lines").cast("long"),
        "n_upper": (chars - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct("__hashes")).cast("long"),
    }
    return step.withColumns(found).drop("__text", "__words", "__lines", "__hashes", "__n")


def features() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "distinct_share": per("n_distinct_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    support: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _bins(labelled: DataFrame, limits: Limits) -> tuple[DataFrame, dict[str, list[float]]]:
    """Labelled rows as counts of bin vectors: b_<feature> is the number of thresholds below the value."""
    probs = [(k + 1) / (limits.quantiles + 1) for k in range(limits.quantiles)]
    found = labelled.agg(*[F.percentile_approx(v, probs, 2000).alias(k) for k, v in features().items()]).first()
    cuts = {k: sorted(set(found[k] or [])) for k in FEATURES}
    bins = [sum((F.when(v > t, 1).otherwise(0) for t in cuts[k]), F.lit(0)).alias(f"b_{k}") for k, v in features().items()]
    part = F.pmod(F.xxhash64("doc_id", F.lit("grow or prune")), F.lit(3)) < 2
    rows = labelled.select(*bins, part.alias("grow"), (F.col("quality") == 0).cast("long").alias("bad"))
    keys = [f"b_{k}" for k in FEATURES]
    counted = rows.groupBy("grow", *keys).agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    return cut(counted), cuts


def _holds(c: Condition, cuts: dict[str, list[float]]) -> Column:
    k = cuts[c.feature].index(c.threshold)
    return F.col(f"b_{c.feature}") > k if c.above else F.col(f"b_{c.feature}") <= k


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    """FOIL's information gain of going from (bad0, good0) to (bad, good)."""
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0))) if bad else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]], limits: Limits) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < limits.conditions:
        here = rows.filter(F.col("grow") & _all([_holds(c, cuts) for c in rule]))
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b_{k}").alias("b")) for i, k in enumerate(FEATURES)])).alias("x")
        counts = here.select(pairs, "bad", "good").groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
        table = {(r["f"], r["b"]): (r["bad"], r["good"]) for r in counts}  # features * (quantiles + 1) rows at most
        bad0, good0 = (sum(v[i] for k, v in table.items() if k[0] == 0) for i in (0, 1))
        if not bad0 or not good0:
            break
        best: tuple[float, Condition] | None = None
        for i, name in enumerate(FEATURES):
            for k, t in enumerate(cuts[name]):
                low = [sum(v[j] for key, v in table.items() if key[0] == i and key[1] <= k) for j in (0, 1)]
                for above, (bad, good) in ((False, low), (True, (bad0 - low[0], good0 - low[1]))):
                    g = _gain(bad, good, bad0, good0)
                    if bad >= limits.support and g > 1e-9 and (best is None or g > best[0] + 1e-9):
                        best = (g, Condition(name, above, t))
        if best is None:
            break
        rule.append(best[1])
    return rule


def learn(labelled: DataFrame, limits: Limits = Limits()) -> Rules:
    """An ordered list of rules for bad documents (quality 0) from rows with doc_id, quality and the counts of COUNTS."""
    rows, cuts = _bins(labelled, limits)
    rules = Rules()
    while True:
        conditions = _grow(rows, cuts, limits)
        if not conditions:
            break
        if len(rules) == limits.rules:
            rules.stopped = "limit"
            break
        cols = [
            F.sum(F.when(_all([_holds(c, cuts) for c in conditions[:k]]), F.col(what)).otherwise(0)).alias(f"{what}{k}")
            for k in range(1, len(conditions) + 1)
            for what in ("bad", "good")
        ]
        counts = rows.filter(~F.col("grow")).agg(*cols).first()
        worth = [((counts[f"bad{k}"] or 0) - (counts[f"good{k}"] or 0)) / max(1, (counts[f"bad{k}"] or 0) + (counts[f"good{k}"] or 0)) for k in range(1, len(conditions) + 1)]
        k = max(range(len(worth)), key=lambda i: (worth[i], -i)) + 1
        bad, good = counts[f"bad{k}"] or 0, counts[f"good{k}"] or 0
        if bad + good == 0 or bad / (bad + good) < limits.precision:
            rules.stopped = "imprecise"
            break
        rules.append(Rule(tuple(conditions[:k]), bad / (bad + good), bad + good))
        rows = rows.filter(~_all([_holds(c, cuts) for c in conditions[:k]]))
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """kept by the list, and the number of the rule that fired (null: none), as ordered conditionals."""
    fired = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        fired = F.when(r.column(), F.lit(i)).otherwise(fired)
    return fired.isNull(), fired


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, Rules]:
    """docs without their text, with statistics, base_failed, kept and rule; and the rules."""
    found = cut(statistics(docs).drop("text"))
    marked = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
    labelled = cut(without(found, "quality").filter(~base_failed()).join(marked, "doc_id"))
    rules = learn(labelled, limits)
    kept, fired = verdict(rules)
    out = without(found, "base_failed", "kept", "rule").withColumn("base_failed", base_failed())
    return out.withColumns({"kept": ~F.col("base_failed") & kept, "rule": fired}), rules


def filter_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents, texts included, that pass the base rules and a learned list."""
    return shielded(docs, ("text",), lambda d: statistics(d).filter(~base_failed() & verdict(rules)[0]))
