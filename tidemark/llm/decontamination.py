"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become templates: numbers (digits, or number words, also several in a row), names and units are replaced by typed
placeholders, the rest is lower-cased and loses its punctuation. Windows of WINDOW template words of the documents meet those of
the benchmark items in a hash join; an item of fewer words is one window of its own length, which is looked for in every
document. An item is found in a document that holds PERCENT of its distinct windows, by their own or by their second keys, in
which every capitalised word is a name, also where it opens a sentence. Where such an item has placeholders, its values are
laid beside the document's: at one alignment each value of the item must stand for one value of the document and the other way
round; all alignments that show nearly all placeholders are judged. Values are compared without the punctuation around them; a name that
opens a sentence of the item counts as a value too where the item has it as a name elsewhere. Equal values mean a copy, other consistent ones a
re-parameterised question, inconsistent ones no leak.

Defined results: null text is empty and contains nothing; items without a word are found nowhere; repeated rows of a document
or an item count once; a document of a null id or an item of a null id takes no part; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_size, cut_table, scratch, text_of

WINDOW = 5
PERCENT = 75
#: Placeholders, from the private use area: number, name, unit.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"

# Units as they follow a number, and the words of the grammar of English numbers.
UNITS = (
    "km|m|cm|mm|mi|ft|yd|in|kg|g|mg|lb|lbs|oz|t|l|ml|s|sec|min|h|hr|hrs|mph|kph|Hz|kHz|MHz|GHz|V|A|W|kW|kWh|J|kJ|N|Pa|mol|K|B|KB|MB|GB|TB|%|°C|°F|"
    "hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|foot|feet|inch(?:es)?|yards?|acres?|tons?|tonnes?|gallons?|(?:kilo|centi|milli)?(?:meters?|metres?|grams?|liters?|litres?)|"
    "pounds?|ounces?|dollars?|euros?|cents?|percent|degrees?"
)
NUMBER_WORDS = (
    "zero|on(?:e|ce)|t(?:wo|wice|hree|hrice|en|welve|hirteen|wenty|hirty|hirds?|housands?)|f(?:our|ive|ourteen|ifteen|orty|ifty)|s(?:ix|even|ixteen|eventeen|ixty|eventy)|e(?:ight|leven|ighteen|ighty)|"
    "nine(?:teen|ty)?|h(?:undreds?|alf|alves)|millions?|billions?|dozens?|quarters?"
)
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: A number word; the look at its first letter comes first, as it fails fastest.
_WORD = rf"(?=[ZOTFSENHMBDQzotfsenhmbdq]){_EDGE}(?i:{NUMBER_WORDS}){_END}"
#: In order. Only a number in several words spans white space; raw_words joins its words too, so places stay the same.
STEPS = (
    (rf"(?=[+\-0-9]){_EDGE}[+-]?\d+(?:[.,:/]\d+)*", NUMBER),
    (rf"{_WORD}(?:(?: +(?:and +)?|-){_WORD})*", NUMBER),
    (rf"({NUMBER} ?)(?:{UNITS}){_END}", f"$1{UNIT}"),
    (r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;\uE000\uE002] )\p{Lu}[\p{L}\p{N}'’-]*", NAME),
)
#: The space inside a number in several words.
_WITHIN = (rf"({_WORD}) +(?:(and) +)?(?={_WORD})", "$1-$2")


def _spaced(text: Column) -> Column:
    """The text with one space between words: line breaks and wide spaces change no template."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def cased_words(text: Column) -> Column:
    """The words of the template before they are lower-cased."""
    out = reduce(lambda c, step: F.regexp_replace(c, *step), STEPS, _spaced(text))
    return F.filter(F.split(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{SPACE}{NUMBER}{NAME}{UNIT}]+", ""), f"[{SPACE}]+"), lambda w: w != "")


def template_words(text: Column, opening: bool = False) -> Column:
    """The words of the template; with opening, every word that begins with a capital is a name."""
    first = lambda w: F.substring(w, 1, 1)
    return F.transform(cased_words(text), lambda w: F.when(first(w) != F.lower(first(w)), F.lit(NAME)).otherwise(F.lower(w)) if opening else F.lower(w))


def raw_words(text: Column) -> Column:
    """The words behind template_words, one for one."""
    return F.filter(F.split(F.regexp_replace(_spaced(text), *_WITHIN), " "), lambda w: w.rlike(rf"[\p{{L}}\p{{N}}{NUMBER}{NAME}{UNIT}%]"))


def slot_value(raw: Column) -> Column:
    """What a placeholder stands for: lower-case, without the punctuation around it and the commas inside large numbers; a number keeps its sign."""
    plain = F.regexp_replace(F.lower(raw), r"(?<=\d),(?=\d{3}(?!\d))", "")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}%°]+$", "")
    return F.regexp_replace(plain, r"^[^\p{L}\p{N}]*?(?=[+-]?\d)|^[^\p{L}\p{N}%°]+(?![\d+-])", "")


def windows(words: Column, size: int = WINDOW) -> Column:
    """Hashes of all windows of a size, by place; fewer words give none."""
    n = F.size(words)

    def hashes(h: Column) -> Column:
        whole = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), whole))

    return F.coalesce(F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), hashes), F.lit(0)), F.array().cast("array<bigint>"))


def item_sizes(benchmark: DataFrame) -> list[int]:
    """Sizes of the windows that a benchmark needs: WINDOW, and for shorter items their own length."""
    n = F.size(template_words(text_of()))
    short = benchmark.filter(F.col("item_id").isNotNull()).select(n.alias("n")).filter(F.col("n").between(1, WINDOW - 1)).distinct().collect()
    return sorted(r["n"] for r in short) + [WINDOW]  # WINDOW numbers at most


def own_windows(words: Column) -> Column:
    """The windows of an item: a short one is one window of its own length."""
    out = windows(words)
    for k in range(1, WINDOW):
        out = F.when(F.size(words) == k, windows(words, k)).otherwise(out)
    return out


def document_windows(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, key and first (whether it is a plain window's own key) for all windows of the documents, by both keys.

    Hashes of words are made in lambda functions; windows are put together after an explosion, in compiled code.
    """
    first = lambda w: F.substring(w, 1, 1)
    own = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.array(cased_words(text_of()))).alias("c"))
    own = own.select("doc_id", "c", F.transform("c", lambda w: F.xxhash64(F.lower(w))).alias("h"))
    own = own.select("doc_id", "h", F.zip_with("c", "h", lambda w, h: F.when(first(w) != F.lower(first(w)), F.xxhash64(F.lit(NAME))).otherwise(h)).alias("o"))
    own = own.withColumn("h", F.explode(F.array("h")))  # parts the lambda functions from what follows
    parts = []
    for k in sizes:
        long = own.filter(F.size("h") >= k)
        at = [F.slice(F.col(c), F.lit(i + 1), F.size("h") - (k - 1)).alias(f"{c}{i}") for c in ("h", "o") for i in range(k)]
        each = long.select("doc_id", F.explode(F.arrays_zip(*at)).alias("x"))
        keys = [F.xxhash64(*[F.col(f"x.{c}{i}") for i in range(k)]) for c in ("h", "o")]
        both = each.select("doc_id", keys[0].alias("plain"), keys[1].alias("second"))
        # the second key only where it differs
        parts.append(both.select("doc_id", F.explode(F.array(F.struct(F.col("plain").alias("key"), F.lit(True).alias("first")), F.struct(F.when(F.col("second") != F.col("plain"), F.col("second")).alias("key"), F.lit(False).alias("first")))).alias("y")).select("doc_id", "y.key", "y.first").filter("key is not null"))
    return reduce(DataFrame.unionByName, parts)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, window, key, plain and n_windows: the distinct windows of each item, by their own and their second keys."""
    words = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", template_words(text_of()).alias("w"), template_words(text_of(), True).alias("o"))
    both = F.arrays_zip(own_windows(F.col("w")).alias("window"), own_windows(F.col("o")).alias("second"))
    own = words.select("item_id", F.explode(both).alias("x")).select("item_id", "x.window", F.explode(F.array("x.window", "x.second")).alias("key")).distinct()
    counted = own.groupBy("item_id").agg(F.count_distinct("window").alias("n_windows"))
    return own.withColumn("plain", F.col("key") == F.col("window")).join(counted, "item_id")


def shared_windows(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_plain (without second keys), n_windows, for items of which a document holds enough windows."""
    items = by_size(cut_table(item_windows(benchmark)), 64)
    own = document_windows(docs, item_sizes(benchmark))
    met = own.join(items, "key").groupBy("doc_id", "item_id", "window").agg(F.first("n_windows").alias("n_windows"), F.max(F.col("plain") & F.col("first")).alias("plain"))
    found = met.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.count_if("plain").alias("n_plain"), F.first("n_windows").alias("n_windows"))
    return found.filter(100 * F.col("n_shared") >= percent * F.col("n_windows"))


def _slots(words: DataFrame, key: str) -> DataFrame:
    """key, place, raw word and template word."""
    return words.select(key, F.posexplode(F.arrays_zip(F.col("r"), F.col("w"))).alias("place", "x")).select(key, "place", F.col("x.r").alias("raw"), F.col("x.w").alias("word"))


def slot_checks(pairs: DataFrame, docs: DataFrame, benchmark: DataFrame, opening: bool = False) -> DataFrame:
    """doc_id, item_id, n_slots, n_changed and consistent, over the placeholders of shared windows laid side by side."""
    both = lambda df, key: df.select(key, template_words(text_of(), opening).alias("w"), raw_words(text_of()).alias("r"))
    items = both(benchmark.filter(F.col("item_id").isNotNull()), "item_id").dropDuplicates(["item_id"])
    slotted = items.filter(F.exists("w", lambda w: w.rlike(f"[{NUMBER}{NAME}{UNIT}]")))
    wanted = cut_table(pairs.join(slotted.select("item_id"), "item_id", "left_semi").select("doc_id", "item_id"))
    held = docs.select("doc_id", "text").join(by_size(wanted.select("doc_id").distinct(), 16), "doc_id", "left_semi")
    held = both(held, "doc_id").dropDuplicates(["doc_id", "w", "r"])

    def placed(df: DataFrame, key: str, at: Column) -> DataFrame:
        return df.select(key, "r", "w", F.explode(at).alias("x")).select(key, "r", "w", "x.at", "x.window", "x.k")

    def by_place(found: Column, k: Column) -> Column:
        return F.transform(found, lambda h, i: F.struct(i.alias("at"), h.alias("window"), k.alias("k")))

    def laid_out(slotted: DataFrame, held: DataFrame) -> DataFrame:
        """doc_id, item_id, shift, place, word (of the item's template), ours and theirs, for the words of shared windows."""
        w = F.col("w")
        item_at = by_place(own_windows(w), F.least(F.size(w), F.lit(WINDOW)))
        doc_at = F.concat(*[by_place(windows(w, k), F.lit(k)) for k in item_sizes(benchmark)])
        item_side = placed(slotted, "item_id", item_at).select("item_id", "window", "k", F.col("at").alias("item_at"), F.slice("r", F.col("at") + 1, F.col("k")).alias("item_raw"), F.slice("w", F.col("at") + 1, F.col("k")).alias("word"))
        doc_side = placed(held, "doc_id", doc_at).select("doc_id", "window", "k", "at", F.slice("r", F.col("at") + 1, F.col("k")).alias("doc_raw"))
        laid = wanted.join(doc_side, "doc_id").join(item_side, ["item_id", "window", "k"]).drop("k")
        laid = laid.withColumn("shift", F.col("at") - F.col("item_at"))
        each = laid.select("doc_id", "item_id", "shift", "item_at", F.posexplode(F.arrays_zip("item_raw", "doc_raw", "word")).alias("k", "x"))
        each = each.filter(F.col("x.word").rlike(f"[{NUMBER}{NAME}{UNIT}]"))
        return each.select("doc_id", "item_id", "shift", (F.col("item_at") + F.col("k")).alias("place"), slot_value(F.col("x.item_raw")).alias("ours"), slot_value(F.col("x.doc_raw")).alias("theirs")).distinct()

    slots = laid_out(slotted, held)
    if not opening:
        # names that open sentences: of the items that have them as names elsewhere too
        names = F.array_distinct(F.transform(F.filter(F.arrays_zip("r", "w"), lambda x: x["w"] == NAME), lambda x: slot_value(x["r"])))
        named = slotted.select("item_id", F.explode(names).alias("ours"))
        opened = lambda df, key: df.join(wanted.select(key).distinct(), key, "left_semi").select(key, "text", template_words(text_of(), True).alias("w"), raw_words(text_of()).alias("r")).drop("text")
        more = laid_out(opened(benchmark.filter(F.col("item_id").isNotNull()), "item_id").dropDuplicates(["item_id"]), opened(docs.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id", "w", "r"]))
        slots = slots.unionByName(more.join(named, ["item_id", "ours"], "left_semi").select(*slots.columns)).distinct()
    # every alignment with nearly as many placeholders as the fullest one is judged; one consistent alignment is enough
    by_shift = slots.groupBy("doc_id", "item_id", "shift").agg(
        F.count("*").alias("n_slots"),
        F.count_distinct("ours").alias("a"),
        F.count_distinct("theirs").alias("b"),
        F.count_distinct("ours", "theirs").alias("ab"),
        F.sum((F.col("ours") != F.col("theirs")).cast("long")).alias("n_changed"),
    ).withColumn("consistent", (F.col("a") == F.col("ab")) & (F.col("b") == F.col("ab")))
    most = by_shift.groupBy("doc_id", "item_id").agg(F.max("n_slots").alias("most"))
    judged = by_shift.join(most, ["doc_id", "item_id"]).filter(100 * F.col("n_slots") >= PERCENT * F.col("most"))
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("consistent", "n_slots", -F.col("n_changed"), -F.col("shift"), "n_changed")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_slots", "x.n_changed", "x.consistent")


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_windows, n_slots, n_changed: a row for each item leaked into a document.

    A pair that isn't found by its plain windows and their values is looked at again with the second keys and theirs.
    """
    pairs = cut_table(shared_windows(docs, benchmark, percent))
    none = F.lit(0).cast("long")

    def consistent(some: DataFrame, n_shared: str, opening: bool) -> DataFrame:
        checked = some.join(slot_checks(some, docs, benchmark, opening), ["doc_id", "item_id"], "left").filter(F.coalesce("consistent", F.lit(True)))
        return checked.select("doc_id", "item_id", F.col(n_shared).alias("n_shared"), "n_windows", F.coalesce("n_slots", none).alias("n_slots"), F.coalesce("n_changed", none).alias("n_changed"))

    plain = cut_table(consistent(pairs.filter(100 * F.col("n_plain") >= percent * F.col("n_windows")), "n_plain", False))
    rest = cut_table(pairs.join(plain.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti"))
    return plain.unionByName(consistent(rest, "n_shared", True))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaked, in the columns that docs has."""
    with scratch(docs.sparkSession) as keep:
        leaked = keep(find_leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(by_size(leaked, 16), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
