"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

Documents are split at line feeds. A line with a word is the set of its distinct lower-cased words, its tokens, in the order of
their rarity over all lines. It is removed if an earlier line, in order of (doc_id, line number), has a set with a Jaccard
similarity of PERCENT / 100 or more. Lines with equal sets are one node, at the place of the first, however many there are.
Nodes meet through the tokens of their prefixes (setjoin), pass length, positional and parity filters, and are verified on
their full sets. First a semi-join leaves the rows that pass with any other at their key. Of these, nodes meet the first node of
their key, those that aren't like it the first one that is left, and only what is left then meets all earlier ones.

Defined results: null text counts as empty (no lines, stays null); white space alone is no line; rows that repeat a doc_id are
one document in order, so lines at the same place don't remove one another; documents without an id neither lose lines nor
take any; an empty table gives an empty result; other columns stay, and input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import SPACE, by_size, cut_table, scratch, shielded, text_of, without

PERCENT = 75
#: Rounds in which nodes meet one earlier node of each key, before those that are left meet all.
STARS = 2
#: Removed line numbers of at most so many bytes are broadcast to the texts, which would be shuffled else.
GONE_BYTES = 32 << 20


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (its number from 0) and its text, for lines with a word."""
    split = F.posexplode_outer(F.split(text_of("text"), "\n", -1)).alias("line", "words")
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", split).filter(F.col("words").rlike(f"[^{SPACE}]"))


def _words(text: Column) -> Column:
    """Lower-cased words of a text without line feeds, some of which may be empty; only rare white space needs a slow pattern."""
    low = F.lower(text)
    return F.when(low.rlike(r"[\x09\x0B-\x0D]"), F.split(low, f"[{SPACE}]")).otherwise(F.split(low, " "))


def _with_tokens(lines: DataFrame, levels: Column) -> DataFrame:
    """Lines with t, their tokens, instead of their words."""
    return setjoin.tokens(lines, F.array_remove(F.transform(_words(F.col("words")), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))), levels, "t").drop("words")


def line_sets(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, Column]:
    """A row for each line with a word: doc_id, line, id (of its set) and the columns of setjoin.described; and the rarity levels."""
    words = docs.filter(F.col("doc_id").isNotNull()).select(F.explode(_words(F.replace(text_of("text"), F.lit("\n"), F.lit(" ")))).alias("w"))
    levels = setjoin.rarity_levels(words.filter("w <> ''").select(F.xxhash64("w").alias("h")), "h")
    sets = _with_tokens(_lines(docs), levels)
    return cut_table(sets.select("doc_id", "line", F.xxhash64("t").alias("id"), *[v.alias(k) for k, v in setjoin.described(F.col("t"), percent, fine=True).items()])), levels


def line_nodes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row of lines for each set, at its first place; and id and first (that place) of the sets of several lines."""
    place = F.struct("doc_id", "line")
    several = cut_table(lines.groupBy("id").agg(F.count("*").alias("k"), F.min(place).alias("first")).filter("k > 1").select("id", "first"))
    marked = lines.join(by_size(several, 32), "id", "left")
    once = marked.filter(F.col("first").isNull()).drop("first")
    firsts = cut_table(marked.filter(F.col("first") == place).drop("first").dropDuplicates(["id"]))
    return once.unionByName(firsts), several


def node_sets(docs: DataFrame, at: DataFrame, levels: Column) -> DataFrame:
    """id and t, its tokens, of the nodes at places (id, at)."""
    wanted = at.select("id", "at.doc_id", "at.line")
    texts = docs.select("doc_id", "text").join(by_size(cut_table(wanted.select("doc_id").distinct()), 16), "doc_id", "left_semi")
    sets = _with_tokens(_lines(texts).join(by_size(wanted, 40), ["doc_id", "line"]), levels).select("id", "t")
    # of rows that repeat a doc_id, the one whose line has this set
    return cut_table(sets.filter(F.xxhash64("t") == F.col("id")).dropDuplicates(["id"]))


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id and other of the later nodes of pairs (id, earlier, other), with the earliest node that is like them on full sets."""
    ends = cut_table(pairs.select(F.explode(F.array("id", "earlier")).alias("id")).distinct())
    sets = by_size(sets.join(by_size(ends, 16), "id", "left_semi"), 600)
    both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("earlier"), F.col("t").alias("u")), "earlier")
    both = both.filter(setjoin.similar(F.size(F.array_intersect("t", "u")), F.size("t"), F.size("u"), percent))
    return cut_table(both.groupBy("id").agg(F.min("other").alias("other")))


def met(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """id of rows y that pass the filters with an earlier row x of their key, and that one's id and place: earlier and other."""
    side = lambda name: lambda c: F.col(f"{name}.{c}")
    holds = (F.col("x.key") == F.col("y.key")) & (F.col("x.shared") == F.col("y.shared")) & (F.col("x.at") < F.col("y.at"))
    pairs = x.alias("x").join(y.alias("y"), holds & setjoin.may_match(side("x"), side("y"), percent, F.col("x.shared"), fine=True))
    return cut_table(pairs.select("y.id", F.col("x.id").alias("earlier"), F.col("x.at").alias("other")).distinct())


def like_earlier(docs: DataFrame, nodes: DataFrame, levels: Column, percent: int) -> DataFrame:
    """id and other of the nodes that have an earlier node like them, and the place of one."""
    rows = setjoin.partnered_rows(nodes, percent)
    ids = cut_table(rows.select("id").distinct())
    at = cut_table(nodes.select("id", F.struct("doc_id", "line").alias("at")).join(by_size(ids, 16), "id"))
    sets = node_sets(docs, at, levels)
    rows = left = cut_table(rows.join(by_size(at, 48), "id"))
    found = None
    for _ in range(STARS):
        centers = left.groupBy("shared", "key").agg(F.min(F.struct("at", *setjoin.OWN, *setjoin.FINE)).alias("c")).select("shared", "key", "c.*")
        more = alike(met(centers, left, percent), sets, percent)
        found = more if found is None else cut_table(found.unionByName(more))
        left = cut_table(left.join(by_size(found.select("id"), 16), "id", "left_anti"))
    return found.unionByName(alike(met(rows, left, percent), sets, percent))


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each removed line: doc_id, line, and an earlier line like it: first_doc, first_line."""
    lines, levels = line_sets(docs, percent)
    nodes, several = line_nodes(lines)
    like = like_earlier(docs, nodes, levels, percent)
    known = several.select("id", F.col("first").alias("earliest")).unionByName(like.select("id", F.col("other").alias("earliest")))
    known = cut_table(known.groupBy("id").agg(F.min("earliest").alias("earliest")))
    own = lines.select("doc_id", "line", "id").join(by_size(known, 32), "id").filter(F.struct("doc_id", "line") != F.col("earliest"))
    return own.select("doc_id", "line", F.col("earliest.doc_id").alias("first_doc"), F.col("earliest.line").alias("first_line"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with their text less the removed lines, n_lines (with a word), n_removed and removed (their numbers)."""
    with scratch(docs.sparkSession) as keep:
        gone = keep(removed_lines(docs, percent).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed")))
    names = ("removed", "n_lines", "n_removed", "__text", "__split")
    found = without(docs, *names).join(by_size(gone, 64, GONE_BYTES), "doc_id", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    left = lambda split: F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed")), lambda i: F.get(split, i))
    text = F.when(F.size("removed") > 0, F.array_join(setjoin.once(F.split(F.col("text"), "\n", -1), left), "\n")).otherwise(F.col("text"))
    n_lines = F.size(F.filter(F.split(text_of("text"), "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    found = found.withColumns({"n_lines": n_lines, "n_removed": F.size("removed"), "__text": text})
    return found.withColumn("text", F.col("__text")).drop("__text")


def stage(docs: DataFrame) -> DataFrame:
    """The documents with the removed lines taken out, in the columns that docs has."""
    return shielded(docs, ("doc_id", "text"), deduplicate)
