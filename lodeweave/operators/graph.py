"""Summaries of the provenance graph: degrees, flags, adjacency, clusters, layers, components, highlights, impact."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.scalars import database_of, table_of
from lodeweave.operators import components
from lodeweave.operators.traverse import reach
from lodeweave.sources.scratch import cut


def nodes_of(edges: DataFrame) -> DataFrame:
    s = edges.select(F.col("source_dataset").alias("dataset"), F.col("source_field").alias("field"), F.col("src").alias("node"))
    return s.union(edges.select("target_dataset", "target_field", "tgt")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree: both ends of each edge in one pass and one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("tgt").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def provenance_flags(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.select("node", (F.col("in_degree") > 0).alias("has_upstream"), (F.col("out_degree") > 0).alias("has_downstream"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("tgt")).alias("targets"))


def database_clusters(datasets: DataFrame) -> DataFrame:
    db = database_of(F.col("name"))
    return datasets.groupBy(db.alias("database")).agg(F.count(F.lit(1)).alias("tables"), F.min("name").alias("first_table"), F.max("name").alias("last_table"), F.count_if(F.col("source_type") == "VIEW").alias("views"))


def cross_database(edges: DataFrame) -> DataFrame:
    s, t = database_of(F.col("source_dataset")), database_of(F.col("target_dataset"))
    return edges.groupBy(s.alias("source_database"), t.alias("target_database")).agg(F.count(F.lit(1)).alias("edges"), F.first(s != t).alias("crosses"))


def highlight(edges: DataFrame, roots: DataFrame, max_depth: int = 10, by_target: DataFrame | None = None) -> DataFrame:
    """root, node: each root with everything upstream and downstream of it. ``by_target``: the same edges in buckets of their target."""
    up, down = (reach(e, roots, direction=d, max_depth=max_depth).select("root", "node") for d, e in (("upstream", edges if by_target is None else by_target), ("downstream", edges)))
    return up.union(down).union(roots.select("root", F.col("root").alias("node"))).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column node)."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "tgt"), "tgt", "left_semi")


def impact(edges: DataFrame, roots: DataFrame, max_depth: int = 10, critical: str = r"^(FACT|RPT)_") -> DataFrame:
    """Downstream assets of the roots: root, node, depth, impact_type (direct at depth 1) and critical (by table name)."""
    found = reach(edges, roots, max_depth=max_depth)
    table = table_of(F.regexp_extract("node", r"^(.*)\.[^.]*$", 1))
    return found.select("root", "node", "depth", database_of(F.col("node")).alias("database"), F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("impact_type"), table.rlike(critical).alias("critical"))


def layer_rank(edges: DataFrame, roots: DataFrame, max_depth: int = 20) -> DataFrame:
    """node, layer of the nodes downstream of the roots: the longest path to a node that a level-by-level relaxation finds
    within max_depth levels. On a graph without cycles this is the layered drawing's rank."""
    step = edges.select(F.col("src").alias("at"), F.col("tgt").alias("node")).distinct()
    level, n = cut(roots.select(F.col("root").alias("node")).distinct())
    out = level.withColumn("layer", F.lit(0))
    for k in range(1, max_depth + 1):
        level, n = cut(step.join(level.withColumnRenamed("node", "at"), "at").select("node").distinct(), after=n)
        if n == 0:
            break
        out = out.unionByName(level.withColumn("layer", F.lit(k)))
    return out.groupBy("node").agg(F.max("layer").alias("layer"))


def weak_component(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node: everything connected to a root when directions are ignored, however far away, and the root itself."""
    component, _ = cut(components.weak_components(edges))  # read twice
    of_root = roots.select("root").distinct().join(component.withColumnRenamed("node", "root"), "root")
    return of_root.join(component, "component").select("root", "node").union(roots.select("root", F.col("root").alias("node"))).distinct()


def layered_edges(spark, nodes: int, layers: int) -> DataFrame:
    """Synthetic layered graph: node i of a layer feeds nodes i and i + 1 of the next, by arithmetic on a range."""
    per = max(1, nodes // layers)
    n = spark.range(per * (layers - 1)).select((F.col("id") / per).cast("long").alias("layer"), (F.col("id") % per).alias("i"))
    hop = n.select("layer", "i", F.explode(F.array(F.col("i"), F.pmod(F.col("i") + 1, F.lit(per)))).alias("j")).distinct()
    name = lambda layer, i: F.concat(F.lit("L"), layer.cast("string"), F.lit(".T.c"), i.cast("string"))
    return hop.select(name(F.col("layer"), F.col("i")).alias("src"), name(F.col("layer") + 1, F.col("j")).alias("tgt"))


# Transformation types of generated edges, by the place of the source in its layer or the number of its table.
CROSS_TYPES = ("DIRECT", "DERIVED", "AGGREGATED", "JOINED")
TABLE_TYPES = ("DIRECT", "DERIVED", "AGGREGATED")


def _cycled(types: tuple[str, ...], k: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in types]), k % len(types))


def _layer_edges(node: DataFrame, name: Callable[[Column, Column, Column], Column], per: int, width: Column, second: Column, second_type: str) -> DataFrame:
    """Edges of ``node`` (layer, i) into the next layer of ``width`` columns: to column i, and to column i + 1 where ``second`` says so.

    Every node finds its targets by arithmetic, so layers are neither listed nor joined. Columns of a narrower layer are met modulo its width."""
    hops = F.filter(
        F.array(F.struct((F.col("i") % width).alias("j"), _cycled(CROSS_TYPES, F.col("i")).alias("kind")), F.when(second, F.struct(((F.col("i") + 1) % width).alias("j"), F.lit(second_type).alias("kind")))),
        lambda x: x.isNotNull(),
    )
    out = node.filter(width > 0).select("layer", "i", F.explode(hops).alias("hop"))
    number = lambda layer, i: layer * per + i
    src = name(number(F.col("layer"), F.col("i")), F.col("layer"), F.col("i"))
    tgt = name(number(F.col("layer") + 1, F.col("hop.j")), F.col("layer") + 1, F.col("hop.j"))
    return out.select(src.alias("src"), tgt.alias("tgt"), F.col("hop.kind").alias("transformation_type"))


def _named(database: str, table: str) -> Callable[[Column, Column, Column], Column]:
    return lambda k, layer, i: F.format_string(f"{database}.{table}_%d.col_%d_%d", k, layer, i)


def square_edges(spark: SparkSession, nodes: int) -> DataFrame:
    """src, tgt, transformation_type of a graph of ``nodes`` columns, one to a table, in about sqrt(nodes) layers: each feeds its
    counterpart in the next layer, and every third one its neighbour too. The last layer may be narrower."""
    layers = max(2, math.isqrt(nodes))
    per = max(1, -(-nodes // layers))
    node = spark.range(nodes).select(F.expr(f"id div {per}").alias("layer"), (F.col("id") % per).alias("i"))
    width = F.least(F.lit(per), F.lit(nodes) - (F.col("layer") + 1) * per)
    return _layer_edges(node, _named("benchmark_db", "TABLE"), per, width, (F.col("i") % 3 == 0) & (width > 1), "DERIVED")


def depth_breadth_edges(spark: SparkSession, depth: int, breadth: int) -> DataFrame:
    """The same columns for a graph of ``depth`` layers of ``breadth`` columns: each feeds its counterpart, every second one but the
    first its neighbour too."""
    node = spark.range(max(0, depth - 1) * breadth).select(F.expr(f"id div {max(1, breadth)}").alias("layer"), (F.col("id") % max(1, breadth)).alias("i"))
    return _layer_edges(node, _named("layered_db", "TBL"), breadth, F.lit(breadth), (F.col("i") > 0) & (F.col("i") % 2 == 0), "JOINED")


def single_database_edges(spark: SparkSession, nodes: int, columns: int = 5) -> DataFrame:
    """The same columns for a chain of tables of one database, each of ``columns`` columns: the first column of a table feeds that of
    the next table, and the second of its own."""
    t = spark.range(max(0, -(-nodes // columns) - 1)).withColumnRenamed("id", "t")
    name = lambda table, k: F.format_string("single_db.FACT_%d.field_%d", table, F.lit(k))
    onward = F.struct(name(F.col("t") + 1, 0).alias("tgt"), _cycled(TABLE_TYPES, F.col("t")).alias("kind"))
    within = [F.struct(name(F.col("t"), 1).alias("tgt"), F.lit("DERIVED").alias("kind"))] if columns > 1 else []
    return t.select(name(F.col("t"), 0).alias("src"), F.explode(F.array(onward, *within)).alias("e")).select("src", "e.tgt", F.col("e.kind").alias("transformation_type"))


def touching(edges: DataFrame, database: str) -> DataFrame:
    """Edges with an end in the database. The name is a whole name: no wildcards."""
    return edges.filter(F.col("source_dataset").startswith(f"{database}.") | F.col("target_dataset").startswith(f"{database}."))


def of_databases(edges: DataFrame, databases: list[str]) -> DataFrame:
    """Edges that start in one of the databases; an empty list keeps all."""
    return edges.filter(database_of(F.col("source_dataset")).isin(*databases)) if databases else edges


def catalog_nodes(datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """node, field_type, nullable, source_type of the registered columns."""
    f = fields.join(datasets.select("dataset_id", "name", "source_type"), "dataset_id")
    return f.select(F.concat_ws(".", "name", "field_name").alias("node"), "name", "field_type", F.coalesce(F.col("nullable") == "Y", F.lit(False)).alias("nullable"), F.coalesce("source_type", F.lit("TABLE")).alias("source_type"))


def database_nodes(edges: DataFrame, datasets: DataFrame, fields: DataFrame, database: str) -> DataFrame:
    """node, field_type, nullable, source_type, own: all columns of the database, and the outer ends of its edges with the
    type that the catalog has for them, in one join instead of a lookup for each."""
    known = catalog_nodes(datasets, fields)
    prefix = f"{database}."
    own = known.filter(F.col("name").startswith(prefix)).drop("name").withColumn("own", F.lit(True))
    outer = nodes_of(touching(edges, database)).filter(~F.col("dataset").startswith(prefix)).select("node", "dataset").distinct()
    kinds = datasets.select(F.col("name").alias("dataset"), F.col("source_type").alias("kind"))
    found = outer.join(known.drop("name", "source_type"), "node", "left").join(kinds, "dataset", "left")
    return own.unionByName(found.select("node", "field_type", F.coalesce("nullable", F.lit(False)).alias("nullable"), F.coalesce("kind", F.lit("TABLE")).alias("source_type"), F.lit(False).alias("own")))


def expand_database(edges: DataFrame, database: str, *, direction: str = "both", max_depth: int = 3, by_target: DataFrame | None = None) -> DataFrame:
    """provenance_id, depth of the edges within max_depth steps of the database's columns. A level is an equi-join for each direction.
    ``by_target``: the same edges in buckets of their target, so that steps upstream move the level and not the edges."""
    ways = []
    if direction in ("both", "downstream"):
        ways.append(edges.select(F.col("src").alias("at"), F.col("tgt").alias("node"), "provenance_id"))
    if direction in ("both", "upstream"):
        ways.append((edges if by_target is None else by_target).select(F.col("tgt").alias("at"), F.col("src").alias("node"), "provenance_id"))
    met = lambda level: reduce(DataFrame.unionByName, [way.join(level.withColumnRenamed("node", "at"), "at") for way in ways])
    own = [edges.filter(F.col(f"{end}_dataset").startswith(f"{database}.")).select(F.col(node).alias("node")) for end, node in (("source", "src"), ("target", "tgt"))]
    level, n = cut(own[0].union(own[1]).distinct())
    near = level.withColumn("depth", F.lit(1))  # of the edges that a node's steps take
    for depth in range(2, max_depth + 1):
        if n == 0:
            break
        level, n = cut(met(level).select("node").distinct().join(near, "node", "left_anti"), after=n)
        near = near.unionByName(level.withColumn("depth", F.lit(depth)))
    if max_depth < 1:
        near = near.limit(0)
    return met(near).groupBy("provenance_id").agg(F.min("depth").alias("depth"))


def page_by_tables(edges: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """Edges of one page of source tables, with total_tables, total_pages and has_next. Tables are distinct first, so the
    sort is over names and not over edges."""
    names = edges.select("source_dataset").distinct()
    total = names.agg(F.count(F.lit(1))).scalar()  # a column of the plan, not a job of its own
    wanted = names.orderBy("source_dataset").offset((page - 1) * size).limit(size)
    out = edges.join(F.broadcast(wanted), "source_dataset", "left_semi").withColumn("total_tables", total)  # at most `size` names
    return out.select("provenance_id", "src", "tgt", "total_tables", F.ceil(F.col("total_tables") / size).cast("long").alias("total_pages"), (F.col("total_tables") > page * size).alias("has_next"))


def orphans(edges: DataFrame, known: DataFrame, end: str) -> DataFrame:
    """provenance_id and the end of the edges whose end the catalog lacks."""
    return edges.join(known.select(F.col("node").alias(end)), end, "left_anti").select("provenance_id", end)
