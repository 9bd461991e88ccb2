"""Records as a tree of Markdown pages and back: text is built and parsed by column functions, files are Spark's.

A synchronized page names the content digest that it was made from (`base`) and the digest of its own text (`page`), and the tree has an index page
with its boundary. So a tree can be compared with a store that has moved on, record by record, without the tree that it once was.

There are two layouts, and every read takes either: rows of JSON by class (`sync`), and one Markdown file for each record (`publish`), in folders
`class=<class>/page=<name>/`, whose pages also list what a record refers to and the evidence for it. Spark writes the files of a publication into a
staged folder, which takes the place of the former one by a rename.

On a local or mounted file system (`file:`) tasks write and read the files of a publication themselves: Hadoop's layer starts several processes there for
each file and a task for each folder that it lists. On other file systems they are Spark's text files; both have the same folders and texts.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidPlanError, LimitError
from ..functions import first_label, percent_encoded
from ..plans.plan import Plan, Provenance, plan
from ..shared import cut
from ..sources.contract import RecordClass
from ..sources.knowledge import Knowledge
from ..sources.store import Files, Snapshot, Store

#: Evidence that a page lists of its record.
EVIDENCE_LISTED = 100
#: Class of the page that holds the boundary of a tree.
INDEX = ".index"
#: What a comparison may find that a review can't propose.
REFUSED = ("removed", "stale_base", "lost_base", "repeated")
_STAMP = r"(?m)^%s: (sha256:[0-9a-f]{64})$"


def _sha(text: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.col(text).cast("binary"), 256))


def _pages(store: Store) -> DataFrame:
    """class, record_id, base and body of a page for each current record."""
    parts = []
    for name, own in store.contract.classes.items():
        rows = store.records(name, digests=True)
        fields = [c for c in own.public_slots() if c in rows.columns]
        lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.to_json(F.struct(F.col(c).alias("v"))))) for c in fields]
        title = F.coalesce(F.col(own.label_slot) if own.label_slot in fields else F.lit(None).cast("string"), F.col("record_id"))
        head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.col("record_id")), F.concat(F.lit("class: "), F.lit(name)), *lines, F.lit("---"))
        parts.append(rows.select(F.lit(name).alias("class"), "record_id", F.col("`.content_digest`").alias("base"), F.concat(head, F.lit("\n\n# "), title, F.lit("\n")).alias("body")))
    return reduce(DataFrame.unionByName, parts)


def pages(store: Store) -> DataFrame:
    """class, record_id and content of a Markdown page for each current record: a front matter of its fields as JSON lines, and its stamps."""
    return _stamped(_pages(store))


def _stamped(rows: DataFrame) -> DataFrame:
    stamps = F.concat(F.lit("base: "), F.col("base"), F.lit("\npage: "), _sha("body"), F.lit("\n"))
    after_id = F.length(F.concat(F.lit("---\nid: "), "record_id", F.lit("\n")))
    content = F.concat(F.left("body", after_id), stamps, F.substr("body", after_id + 1))
    return rows.select("class", "record_id", content.alias("content"))


def _index(store: Store, at: Snapshot) -> DataFrame:
    return store.spark.createDataFrame([(INDEX, at.batch_id, f"---\ncommit_order: {at.commit_order}\n---\n")], "class string, record_id string, content string")


def _file_name(record_id: str) -> Column:
    """A folder's name for any id: letters, digits and -.~ as they are, other bytes as _ and two hexadecimal digits."""
    return F.replace(F.replace(percent_encoded(record_id), F.lit("_"), F.lit("%5F")), F.lit("%"), F.lit("_"))


def _lists(store: Store) -> DataFrame:
    """class, record_id and section: what a page lists below its title. Relationships: the record's references, in order of slot and target, by
    the target's label. Evidence: of a statement the first EVIDENCE_LISTED by id, with support and source, and how many there are."""
    known, spark = Knowledge(store), store.spark
    labels = _union([_labels(store, c) for c in store.contract.classes.values()], spark, "target string, t_class string, t_label string")
    links = []
    for c in store.contract.classes.values():
        refs = [s for s in c.slots if s.reference and not s.sensitive]
        if not refs:
            continue
        named = lambda s: lambda x: F.struct(F.lit(s.name).alias("slot"), x.alias("target"))
        targets = lambda s: F.coalesce(F.col(f"`{s.name}`") if s.multivalued else F.array(F.col(f"`{s.name}`")), F.array().cast("array<string>"))
        each = F.flatten(F.array(*[F.transform(targets(s), named(s)) for s in refs]))
        links.append(store.records(c.name).select(F.lit(c.name).alias("class"), "record_id", F.explode(each).alias("x")).select("class", "record_id", "x.slot", "x.target").filter("target is not null"))
    linked = _union(links, spark, "class string, record_id string, slot string, target string").join(labels, "target", "left")
    shown = F.when(F.col("t_class").isNotNull(), F.concat(F.lit("["), F.col("t_label"), F.lit("](../../class="), F.col("t_class"), F.lit("/page="), _file_name("target"), F.lit(")"))).otherwise(F.col("target"))
    linked = linked.withColumn("line", F.concat(F.lit("* "), F.col("slot"), F.lit(": "), shown))
    # a record's own references: as many as its slots hold
    relations = linked.groupBy("class", "record_id").agg(F.array_sort(F.collect_list(F.struct("slot", "target", "line"))).alias("l"))
    relations = relations.select("class", "record_id", F.concat(F.lit("\n## Relationships\n\n"), F.concat_ws("\n", "l.line"), F.lit("\n")).alias("section"), F.lit(1).alias("place"))

    statements = _union([_labels(store, c).select(F.col("t_class").alias("class"), F.col("target").alias("statement_id")) for c in known.classes("statement")], spark, "class string, statement_id string")
    rows = known.evidence_rows().withColumn("part", F.pmod(F.xxhash64("record_id"), F.lit(16)))
    counted = rows.groupBy("statement_id").agg(F.count("*").alias("n"))
    first = rows.withColumn("__n", F.row_number().over(W.partitionBy("statement_id", "part").orderBy("record_id"))).filter(F.col("__n") <= EVIDENCE_LISTED)
    first = first.withColumn("__n", F.row_number().over(W.partitionBy("statement_id").orderBy("record_id"))).filter(F.col("__n") <= EVIDENCE_LISTED)
    source = F.coalesce(F.when(F.col("source_uri").isNotNull(), F.concat(F.lit("["), F.coalesce("source_title", "source_id"), F.lit("]("), F.col("source_uri"), F.lit(")"))), F.col("source_title"), F.col("source_id"), F.lit("no source"))
    lines = first.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("__n", F.concat(F.lit("* "), F.coalesce("support_type", F.lit("cites")), F.lit(": "), source).alias("line")))).alias("l")).join(counted, "statement_id")
    more = F.when(F.col("n") > EVIDENCE_LISTED, F.concat(F.lit("* and "), (F.col("n") - EVIDENCE_LISTED).cast("string"), F.lit(" more\n"))).otherwise(F.lit(""))
    section = F.concat(F.lit("\n## Evidence\n\n"), F.concat_ws("\n", "l.line"), F.lit("\n"), more)
    evidence = statements.join(lines, "statement_id").select("class", F.col("statement_id").alias("record_id"), section.alias("section"), F.lit(2).alias("place"))
    both = relations.unionByName(evidence).groupBy("class", "record_id").agg(F.array_sort(F.collect_list(F.struct("place", "section"))).alias("s"))
    return both.select("class", "record_id", F.concat_ws("", "s.section").alias("section"))


def _labels(store: Store, own: RecordClass) -> DataFrame:
    rows = store.records(own.name)
    label = [F.col(f"`{own.label_slot}`")] if own.label_slot in rows.columns else []
    return rows.select(F.col("record_id").alias("target"), F.lit(own.name).alias("t_class"), first_label(*label, F.col("record_id")).alias("t_label"))


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def published_pages(store: Store) -> DataFrame:
    """pages, with the lists of `_lists` below the title."""
    rows = _pages(store).join(_lists(store), ["class", "record_id"], "left").withColumn("body", F.concat("body", F.coalesce("section", F.lit("")))).drop("section")
    return _stamped(rows)


def publish(store: Store, path: str, limit: int | None = None) -> str:
    """Replace the tree at a path by one Markdown file for each current record; its digest. limit: a larger store is refused whole.

    The files are written below `<path>.staged` and moved when they are complete, so a reader finds the former tree, or none for the moment of the change, or the new one.
    """
    rows, at = cut(published_pages(store)), store.snapshot()
    if limit is not None and rows.limit(limit + 1).count() > limit:
        raise LimitError(f"more than {limit} records", rule="export_limit")
    staged = f"{path}.staged"
    whole = rows.unionByName(_index(store, at)).select(F.col("content").alias("value"), "class", _file_name("record_id").alias("page"))
    write_pages(whole, staged)
    here = Files(store.spark, path)
    here.fs.delete(here.path(""), True)
    if not here.fs.rename(here.path("").suffix(".staged"), here.path("")):
        raise LimitError(f"{staged} can't be moved", rule="export_rename")
    return tree_digest(rows)


def write_pages(pages: DataFrame, path: str) -> None:
    """Write the values of pages (value, class, page) as files, each in a folder of its own."""
    # a file costs far more than its bytes, so the tasks are dealt by number: by size, small pages would all go to one task
    spark = pages.sparkSession
    rows = pages.repartition(4 * spark.sparkContext.defaultParallelism, "class", "page")
    here = Files(spark, path)
    root = _local(here)
    if root is None:
        rows.write.mode("overwrite").option("lineSep", "\n").partitionBy("class", "page").text(path)
        return
    here.remove("")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, n = None, None, 0
        name = f"part-{TaskContext.get().partitionId():05d}.txt"
        own = f".{uuid.uuid4().hex}"  # a file appears under its name when it is complete, whichever attempt of the task wrote it

        def end() -> None:
            if out is not None:
                out.close()
                os.replace(f"{last}/{own}", f"{last}/{name}")

        for batch in batches:
            for r in batch.to_pylist():
                at = f"{root}/class={_escaped(r['class'])}/page={_escaped(r['page'])}"
                if at != last:
                    end()
                    os.makedirs(at, exist_ok=True)
                    last, out, n = at, open(f"{at}/{own}", "wb"), n + 1
                out.write((r["value"] or "").encode() + b"\n")
        end()
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    rows.select("value", "class", "page").sortWithinPartitions("class", "page").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    here.create("_SUCCESS", "")


def _local(here: Files) -> str | None:
    """The path of a folder on a local or mounted file system, None on others."""
    uri = here.path("").makeQualified(here.fs.getUri(), here.fs.getWorkingDirectory()).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _escaped(value: str | None) -> str:
    """A value as Spark names the folder of a partition."""
    return re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def _read_pages(spark: SparkSession, root: str, index: bool | None) -> DataFrame:
    """value, class and page of the files below a local folder: the folders of a class are listed by one task, all files are dealt out and read by many."""
    classes = [(_unescaped(n.removeprefix("class=")), f"{root}/{n}") for n in sorted(os.listdir(root)) if n.startswith("class=")]
    classes = [c for c in classes if index in (None, c[0] == INDEX)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("class", pa.string()), ("page", pa.string()), ("folder", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                some = []
                for f in os.scandir(r["folder"]):
                    if f.name.startswith("page="):
                        some.append({"class": r["class"], "page": _unescaped(f.name.removeprefix("page=")), "folder": f.path})
                    if len(some) == 10_000:
                        yield pa.RecordBatch.from_pylist(some, kind)
                        some = []
                yield pa.RecordBatch.from_pylist(some, kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("value", pa.binary()), ("class", pa.string()), ("page", pa.string())])
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), 500):
                out = []
                for r in rows[i : i + 500]:
                    for f in sorted(os.listdir(r["folder"])):
                        if not f.startswith(("_", ".")):
                            with open(f"{r['folder']}/{f}", "rb") as file:
                                out.append({"value": file.read(), "class": r["class"], "page": r["page"]})
                yield pa.RecordBatch.from_pylist(out, kind)

    folders = spark.createDataFrame(classes, "class string, folder string").repartition(max(1, len(classes)), "class").mapInArrow(listed, "class string, page string, folder string")
    tasks = 4 * spark.sparkContext.defaultParallelism
    return folders.repartition(tasks, "folder").mapInArrow(read, "value binary, class string, page string").select(F.col("value").cast("string").alias("value"), "class", "page")


def _unescaped(name: str) -> str | None:
    return None if name == "__HIVE_DEFAULT_PARTITION__" else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


def tree_digest(rows: DataFrame) -> str:
    """A digest of a tree that doesn't depend on the order of its pages."""
    one = F.sum(F.xxhash64("class", "record_id", "content").cast("decimal(38,0)"))
    found = rows.agg(F.count("*").alias("n"), one.alias("h")).first()
    return f"tree:{found['n']}:{found['h']}"


def sync(store: Store, path: str, limit: int | None = None) -> str:
    """Replace the tree at a path by the store's current records; its digest. limit: a larger store is refused whole."""
    rows, at = pages(store), store.snapshot()
    if limit is not None and rows.limit(limit + 1).count() > limit:
        raise LimitError(f"more than {limit} records", rule="export_limit")
    # Hive-style folders, one for each class; ids may hold any character, so they stay inside the rows
    rows.unionByName(_index(store, at)).write.mode("overwrite").partitionBy("class").json(path)
    return tree_digest(rows)


def _tree(store: Store, path: str, index: bool | None = None) -> DataFrame:
    """The pages and the index at a path, or one of them, in either layout."""
    of = F.lit(True) if index is None else (F.col("class") == INDEX) == index
    here = Files(store.spark, path)
    if here.exist("class=*/page=*"):
        root = _local(here)
        files = store.spark.read.schema("value string, class string, page string").text(path, wholetext=True) if root is None else _read_pages(store.spark, root, index)
        # a page without an id is named by its folder; a text ends with a line's end of the writer's
        record_id = F.coalesce(F.nullif(F.regexp_extract("value", r"\A---\nid: ([^\n]*)\n", 1), F.lit("")), "page")
        return files.select(record_id.alias("record_id"), F.regexp_replace("value", r"\n\z", "").alias("content"), "class").filter(of)
    return store.spark.read.schema("record_id string, content string, class string").json(path).filter(of)


def edited(store: Store, path: str) -> DataFrame:
    """The pages at a path."""
    return _tree(store, path, index=False)


def status(store: Store, path: str, exported: str) -> str:
    """current, stale (the store moved on), modified (the tree was edited) or both, by the digest of the export."""
    tree, now = tree_digest(edited(store, path)), tree_digest(pages(store))
    return {(True, True): "current", (True, False): "stale", (False, True): "modified", (False, False): "modified and stale"}[tree == exported, now == exported]


def compare(store: Store, path: str) -> DataFrame:
    """class, record_id and kind for every record of the tree or the store, by the content that its page was made from:

    unchanged; edited; added (a page without base, for a record that the store doesn't have); removed (no page, though the store had the record when
    the tree was made); new_in_store (recorded since then); behind (changed in the store, not in the tree); converged (changed in both, with the same fields);
    stale_base (changed in both, or a page without base for a known record); lost_base (its record isn't in the store); repeated (several pages of one record).
    """
    index = _tree(store, path, index=True)
    exported = index.agg(F.max(F.regexp_extract("content", r"(?m)^commit_order: ([0-9]+)$", 1).try_cast("int"))).first()[0]
    stamp = lambda name: F.nullif(F.regexp_extract("content", _STAMP % name, 1), F.lit(""))
    body = F.regexp_replace("content", r"(?m)^(?:base|page): sha256:[0-9a-f]{64}\n", "")
    front = F.regexp_extract("body", r"(?s)\A(.*?\n---\n)", 1)  # what a review reads
    tree = edited(store, path).select("class", "record_id", stamp("base").alias("base"), stamp("page").alias("page"), body.alias("body")).withColumn("now", _sha("body")).withColumn("body", front).withColumn("own", _sha("body"))
    tree = tree.groupBy("class", "record_id").agg(F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ("base", "page", "now", "own")])
    current = _pages(store).select("class", "record_id", F.col("base").alias("head"), front.alias("body")).withColumn("shown", _sha("body")).drop("body")
    first = store.revisions().groupBy("class", "record_id").agg(F.min("commit_order").alias("first"))
    both = tree.join(current, ["class", "record_id"], "full_outer").join(first, ["class", "record_id"], "left")
    changed = ~F.coalesce(F.col("now") == F.col("page"), F.lit(False))
    kind = (
        F.when(F.col("copies") > 1, "repeated")
        .when(F.col("now").isNull(), F.when(F.lit(exported).isNull() | (F.col("first") <= F.lit(exported)), "removed").otherwise("new_in_store"))
        .when(F.col("head").isNull(), F.when(F.col("base").isNull(), "added").otherwise("lost_base"))
        .when(F.col("base") == F.col("head"), F.when(changed, "edited").otherwise("unchanged"))
        .when(F.col("own") == F.col("shown"), "converged")
        .when(F.col("base").isNull() | changed, "stale_base")
        .otherwise("behind")
    )
    return both.select("class", "record_id", kind.alias("kind"))


def review(store: Store, path: str, provenance: Provenance) -> Plan:
    """A plan for the edits of a tree: front matter becomes candidates, and the plan goes the way of any other.

    Removed pages, edits of a page whose record changed since, pages of lost records and repeated pages are refused, each by its kind; pages that the
    store has merely overtaken are left out.
    """
    found = cut(compare(store, path))
    odd = found.filter(F.col("kind").isin(*REFUSED)).groupBy("kind").agg(F.count("*").alias("n"), F.min("record_id").alias("first")).orderBy("kind").first()
    if odd:
        raise InvalidPlanError(f"{odd['n']} pages are {odd['kind'].replace('_', ' ')}, {odd['first']} first", rule=odd["kind"], field=odd["first"])
    tree, candidates = edited(store, path).join(found.filter(F.col("kind").isin("edited", "added", "unchanged")), ["class", "record_id"], "left_semi"), {}
    for name, own in store.contract.classes.items():
        rows = tree.filter(F.col("class") == name)
        cells = [F.col("record_id").alias("id")]
        for s in own.slots:
            if s.name in ("id", "created_at", "updated_at") or s.sensitive:
                continue
            raw = F.regexp_extract("content", rf"(?m)^{s.name}: (\{{.*\}})$", 1)
            kind = "array<string>" if s.multivalued else "string"
            cells.append(F.from_json(F.nullif(raw, F.lit("")), f"v {kind}")["v"].alias(s.name))
        candidates[name] = rows.select(*cells)
    return plan(store, candidates, provenance)
