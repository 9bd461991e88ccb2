"""Property graph over records: node and edge frames, bounded breadth-first expansion by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = ("edge_id", "subject", "predicate", "object", "edge_class", "layer")
NODE_ROLES = ("node", "statement", "evidence", "source", "mention")
#: Most hops of one expansion.
MAX_HOPS = 2


def nodes(records: DataFrame) -> DataFrame:
    """id, class, label, role for records of the roles that are nodes."""
    return records.filter(F.col("role").isin(*NODE_ROLES)).select(F.col("record_id").alias("id"), "class", "label", "role")


def edges(rows: DataFrame, subject: Column, predicate: Column, object_: Column, edge_class: str, layer: str, edge_id: Column | None = None) -> DataFrame:
    """One kind of edge; rows without an object have none."""
    made = rows.select(subject.alias("subject"), predicate.alias("predicate"), object_.alias("object"), F.lit(edge_class).alias("edge_class"), F.lit(layer).alias("layer"), *([edge_id.alias("edge_id")] if edge_id is not None else []))
    made = made.filter("object is not null and subject is not null")
    return (made if edge_id is not None else made.withColumn("edge_id", F.concat_ws("#", "subject", "predicate", "object"))).select(*EDGE)


def about_edges(statements: DataFrame) -> DataFrame:
    """An edge for each entry of a statement's list of subjects, with its place."""
    each = statements.select("record_id", F.posexplode("about").alias("place", "object"))
    edge_id = F.concat(F.col("record_id"), F.lit("#about:"), (F.col("place") + 1).cast("string"))
    return edges(each, F.col("record_id"), F.lit("about"), F.col("object"), "about", "provenance", edge_id)


def expand(frontier: DataFrame, all_edges: DataFrame, direction: str = "both", predicate: str | None = None) -> DataFrame:
    """Edges that touch the frontier (root, id, hop), with root, the end that was reached and the next hop."""
    e = all_edges if predicate is None else all_edges.filter(F.col("predicate") == predicate)
    f = frontier.select("root", F.col("id").alias("__at"), (F.col("hop") + 1).alias("hop"))
    ways = []
    if direction in ("out", "both"):
        ways.append(f.join(e, F.col("subject") == F.col("__at")).withColumn("reached", F.col("object")))
    if direction in ("in", "both"):
        ways.append(f.join(e, F.col("object") == F.col("__at")).withColumn("reached", F.col("subject")))
    out = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    return out.drop("__at")


def neighbors(roots: DataFrame, all_edges: DataFrame, hops: int = 1, direction: str = "both", via: list[str | None] | None = None) -> DataFrame:
    """root, id and the least hop of every node within the hops of roots (id); many roots are expanded at once."""
    if not 1 <= hops <= MAX_HOPS:
        raise ValueError(f"hops must be 1 to {MAX_HOPS}")
    seen = roots.select(F.col("id").alias("root"), "id").withColumn("hop", F.lit(0))
    frontier = seen
    for k in range(hops):
        reached = expand(frontier, all_edges, direction, via[k] if via else None).select("root", F.col("reached").alias("id"), "hop").distinct()
        frontier = reached.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen


def dangling(all_edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Edge ends that are no node."""
    ends = all_edges.select("edge_id", F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject").alias("id")), F.struct(F.lit("object").alias("side"), F.col("object").alias("id")))).alias("e"))
    return ends.select("edge_id", "e.side", "e.id").join(all_nodes.select("id").distinct(), "id", "left_anti")

