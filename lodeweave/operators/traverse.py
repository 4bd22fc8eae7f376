"""Traversals of the column-provenance graph: path-exact walks and reachability.

``walk`` enumerates simple paths level by level, with the node rule (a path never meets a node again) or the edge rule
(never uses an edge again, so the edge that closes a cycle counts). ``reach`` finds nodes with their least depth by a
breadth-first search that drops visited nodes, so diamonds don't multiply paths. In both, each level's plan is cut: a
frontier counted to be small becomes a literal relation that Spark broadcasts, a larger one a written table that Spark
joins as its size asks. Edges that lie in buckets of the end that a step starts from are not moved by any level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.sources.scratch import cut

EDGE = ["provenance_id", "source_dataset", "source_field", "target_dataset", "target_field", "transformation_type", "confidence_score", "src", "tgt"]


def active(edges: DataFrame) -> DataFrame:
    return edges.filter("is_active = 'Y'")


def walk(edges: DataFrame, roots: DataFrame, *, direction: str = "downstream", max_depth: int = 5, rule: str = "node") -> DataFrame:
    """One row for each path that starts at a root: root, the edge's columns, depth (1 to max_depth) and path.

    ``roots``: distinct node ids in column ``root``. ``edges``: active edges with src and tgt. A self-edge of a root is
    returned once, at depth 1: the rule holds from the second edge on.
    """
    near, far = ("src", "tgt") if direction == "downstream" else ("tgt", "src")
    cols = [c for c in EDGE if c in edges.columns]
    step = edges.select(*cols)
    start = F.array(near, far) if rule == "node" else F.array("provenance_id")
    roots, _ = cut(roots)
    level, n = cut(step.join(roots, F.col(near) == F.col("root")).select("root", *cols, F.lit(1).alias("depth"), start.alias("path")))
    out = level
    for depth in range(2, max_depth + 1):
        if n == 0:
            break
        front = level.select("root", F.col(far).alias("at"), F.col("path").alias("before"))
        new = F.col(far) if rule == "node" else F.col("provenance_id")
        found = step.join(front, F.col(near) == F.col("at")).filter(~F.array_contains("before", new))
        level, n = cut(found.select("root", *cols, F.lit(depth).alias("depth"), F.array_append("before", new).alias("path")), after=n)
        out = out.unionByName(level)
    return out


def edges_of(paths: DataFrame) -> DataFrame:
    """Distinct edges of paths, each with its least depth."""
    keys = [c for c in paths.columns if c not in ("depth", "path")]
    return paths.groupBy(*keys).agg(F.min("depth").alias("depth"))


def reach(edges: DataFrame, roots: DataFrame, *, direction: str = "downstream", max_depth: int = 10) -> DataFrame:
    """root, node, depth (the least) of every node other than the root that can be reached within max_depth edges."""
    near, far = ("src", "tgt") if direction == "downstream" else ("tgt", "src")
    step = edges.select(F.col(near).alias("at"), F.col(far).alias("node"))  # made distinct after each join, when few are left
    level, n = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    seen = level
    for depth in range(1, max_depth + 1):
        if n == 0:
            break
        front = level.select("root", F.col("node").alias("at"))
        found = step.join(front, "at").select("root", "node").distinct()
        level, n = cut(found.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), after=n)
        seen = seen.unionByName(level)
    return seen.filter("depth > 0")


def field_provenance(edges: DataFrame, dataset: str | Column, field: str | Column, direction: str = "both", max_depth: int = 5, by_target: DataFrame | None = None) -> DataFrame:
    """direction, root and distinct edges with depth of a field's provenance; the field's name in any case of letters. ``by_target``: the
    same edges in buckets of their target, for steps upstream."""
    out = None
    for way in ("upstream", "downstream") if direction == "both" else (direction,):
        e = active(edges if way == "downstream" or by_target is None else by_target)
        d, f, node = ("source_dataset", "source_field", "src") if way == "downstream" else ("target_dataset", "target_field", "tgt")
        roots = e.filter((F.col(d) == dataset) & (F.upper(f) == F.upper(F.lit(field) if isinstance(field, str) else field))).select(F.col(node).alias("root")).distinct()
        found = edges_of(walk(e, roots, direction=way, max_depth=max_depth)).withColumn("direction", F.lit(way))
        out = found if out is None else out.unionByName(found)
    return out
