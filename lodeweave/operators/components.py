"""Components and layers of a whole provenance graph.

Weak components come from contraction: each round puts the nodes in an order by chance and makes every node and its least neighbour one,
so the graph shrinks by a share each round, and rounds grow with the logarithm of the nodes and not with the length of chains. Strong components come
from colours: every node takes the least node that reaches it, and what also leads back to that node is its
component. Layers are the longest paths of the graph whose strong components are single nodes, found by peeling nodes
whose sources all have a layer; a round reads only the edges of the nodes that the round before has peeled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.sources.scratch import LOCAL_ROWS, cut, drop

#: Rows of a level to a part, at most, of which a task holds a table in its memory; more are sorted.
PART_ROWS = 1_500_000


def join_counted(rows: DataFrame, side: DataFrame, key: str, *, hot: int = 1000, share: int = 20_000) -> DataFrame:
    """Inner join with ``side``, one row for each key, with n, about how many of ``rows`` have it. Keys of over ``hot`` rows and over one
    row in ``share``, of which there are fewer than ``share``, are broadcast, so no task gets all rows of one."""
    total = side.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("n") > max(hot, total // share)
    large = F.broadcast(side.filter(often).drop("n"))
    if total <= hot:
        return rows.join(side.drop("n"), key)
    rest = rows.join(F.broadcast(side.filter(often).select(key)), key, "left_anti")
    return rows.join(large, key).unionByName(rest.join(side.filter(~often).drop("n"), key))


def _hashed(node: str | Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), node)


def _numbered(nodes: DataFrame) -> int:
    """A salt that gives all of ``nodes`` (node, distinct) hashes of their own."""
    salt = 0
    while nodes.groupBy(_hashed("node", salt).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        salt += 1
    return salt


def _next(of: str | Column, rounds: int = 1) -> Column:
    """The id after some rounds of a node that nothing else was contracted to. The hash of one number is invertible, so ids stay apart."""
    out = F.col(of) if isinstance(of, str) else of
    for _ in range(rounds):
        out = F.xxhash64(out)
    return out


def star_rounds(edges: DataFrame) -> tuple[DataFrame, int]:
    """node, component (the least node of it) of every end of ``edges`` (src, tgt), and the number of rounds.

    A round hashes the ids, which puts them in an order by chance, and contracts every node to the least of itself and its neighbours.
    Half of a chain's nodes are left by it, of other graphs fewer, so all rounds together move little more than the first ones."""
    ends = edges.select("src", "tgt")
    nodes, _ = cut(ends.select(F.col("src").alias("node")).union(ends.select("tgt")).distinct())
    salt = _numbered(nodes)
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    links, n = cut(ends.filter("src <> tgt").select(_hashed("src", salt).alias("u"), _hashed("tgt", salt).alias("v")).select(*pair).distinct())
    maps = []
    while n != 0:
        near = links.select(F.explode(F.array(F.struct("u", F.col("v").alias("w")), F.struct(F.col("v").alias("u"), F.col("u").alias("w")))).alias("e"))
        least = near.groupBy("e.u").agg(F.min(F.xxhash64("e.w")).alias("new"), F.count(F.lit(1)).alias("n"))
        least, _ = cut(least.select("u", F.least("new", _next("u")).alias("new"), "n"), after=n)
        half = join_counted(links, least, "u").select(F.col("v").alias("u"), F.col("new").alias("other"))
        both = join_counted(half, least, "u").select(F.col("other").alias("u"), F.col("new").alias("v"))
        old = links
        links, n = cut(both.filter("u <> v").select(*pair).distinct(), after=n)
        drop(old)
        maps.append(least)
    # From the last round back, where the node that a node was contracted to went in its turn; a node without links stays what it is.
    found = None
    for k in range(len(maps) - 1, -1, -1):
        here, old = maps[k].select(F.col("u").alias("id"), "new"), found
        if old is None:
            found = here.withColumnRenamed("new", "to")
        else:
            onward = old.withColumnRenamed("id", "new")
            found, _ = cut(here.join(onward, "new", "left").select("id", F.coalesce("to", _next("new", len(maps) - 1 - k)).alias("to")))
            drop(old, maps[k])
    placed = nodes.withColumn("id", _hashed("node", salt))
    if found is None:
        return placed.select("node", F.col("node").alias("component")), 0
    placed, _ = cut(placed.join(found, "id", "left").select("node", F.coalesce("to", _next("id", len(maps))).alias("to")))
    drop(nodes, found)
    names, _ = cut(placed.groupBy("to").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")))
    return join_counted(placed, names, "to").select("node", "component"), len(maps)


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that is connected to it when directions are ignored, of every end of ``edges`` (src, tgt).
    Repeated edges and self-edges change nothing; edges with a null end connect nothing."""
    return star_rounds(edges.filter("src is not null and tgt is not null"))[0]


def _peeled(edges: DataFrame, parts: int) -> tuple[DataFrame, bool]:
    """node, layer of the ends of ``edges`` that no cycle leads to, and whether these are all: the layer is the number of edges of the longest
    path to it. ``edges``: src, tgt, no pair twice, in ``parts`` buckets of src or few; self-edges only name their nodes.

    Levels move and edges do not: a round meets the edges of the nodes that the round before has peeled, and moves what these lose to
    their targets. A node that one edge leads to is peeled with it, so only other numbers of edges are stored, in buckets of the node."""
    steps = edges.filter("src <> tgt")
    degree = steps.groupBy(F.col("tgt").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    named, left = edges.select(F.col("src").alias("node")).distinct(), steps.count()
    stored, _ = cut(named.join(degree, "node", "full").filter("degree is null or degree > 1"), after=edges.count(), by="node", parts=parts)
    level = stored.filter("degree is null").select("node")
    many, waiting, layer, n = stored.filter("degree is not null"), None, 0, level.count()
    m, large, few = n, [level.withColumn("layer", F.lit(0))], []
    while n != 0:
        layer += 1
        front = level.withColumnRenamed("node", "src")
        front = front.hint("shuffle_hash") if LOCAL_ROWS < n <= parts * PART_ROWS else front  # edges need no sort then
        lost = steps.join(front, "src").select(F.col("tgt").alias("node"), F.lit(1).cast("long").alias("lost"))
        lost = (lost if waiting is None else lost.unionByName(waiting)).groupBy("node").agg(F.sum("lost").alias("lost"))
        done = (F.col("lost") == F.coalesce("degree", F.lit(1))).alias("done")
        counted, m = cut(lost.join(many, "node", "left").select("node", "lost", done), after=m)
        level, waiting = counted.filter("done").select("node"), counted.filter("not done").select("node", "lost")
        n, gone = counted.filter("done").agg(F.count(F.lit(1)), F.coalesce(F.sum("lost"), F.lit(0))).first()
        left -= gone
        (few if m <= LOCAL_ROWS else large).append(level.withColumn("layer", F.lit(layer)))
        if len(few) == 20:
            large.append(cut(reduce(DataFrame.unionByName, few), after=None)[0])
            few = []
    return reduce(DataFrame.unionByName, large + few), left == 0


def _colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches it, itself included."""
    colour, _ = cut(nodes.select("node", F.col("node").alias("colour")))
    moved, n = colour, 1
    while n != 0:
        step = edges.join(moved.withColumnsRenamed({"node": "src", "colour": "new"}), "src").groupBy(F.col("tgt").alias("node")).agg(F.min("new").alias("new"))
        moved, n = cut(step.join(colour, "node").filter("new < colour").select("node", F.col("new").alias("colour")))
        if n != 0:
            old = colour
            colour, _ = cut(old.join(moved.withColumnRenamed("colour", "less"), "node", "left").select("node", F.coalesce("less", "colour").alias("colour")))
            drop(old)
    return colour


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node) of ``nodes``: nodes that lead to each other. ``edges``: src, tgt, both ends in ``nodes``; written
    tables. A round finds the components of all nodes that no lesser node reaches."""
    out = None
    left_nodes, left_edges, n = nodes, edges, 1
    while n != 0:
        colour = _colours(left_nodes, left_edges)
        of = lambda end: colour.withColumnsRenamed({"node": end, "colour": f"{end}_colour"})
        within, _ = cut(left_edges.join(of("src"), "src").join(of("tgt"), "tgt").filter("src_colour = tgt_colour").select("src", "tgt"))
        found, _ = cut(colour.filter("node = colour"))
        level, k = found, 1
        while k != 0:  # backwards from each colour's own node
            before = within.join(level.withColumnRenamed("node", "tgt"), "tgt").select(F.col("src").alias("node"), "colour").distinct()
            level, k = cut(before.join(found, "node", "left_anti"))
            if k != 0:
                found, _ = cut(found.unionByName(level))
        named = found.withColumnRenamed("colour", "component")
        out = named if out is None else cut(out.unionByName(named))[0]
        left_nodes, n = cut(left_nodes.join(found, "node", "left_anti"))
        keep = lambda end: left_nodes.withColumnRenamed("node", end)
        left_edges, _ = cut(left_edges.join(keep("src"), "src", "left_semi").join(keep("tgt"), "tgt", "left_semi"))
        drop(colour, within)
    return out


def layers(edges: DataFrame, *, distinct: bool = False, parts: int | None = None) -> DataFrame:
    """node, component, layer of every end of ``edges`` (src, tgt): nodes of a cycle are one component, by its least node, and have one
    layer; it is the number of edges between components on the longest path to it. There is no bound on depth.

    ``distinct``: no edge is there twice, and edges lie in ``parts`` buckets of src, so that they are read where they are; others are written once."""
    parts = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = edges.filter("src is not null and tgt is not null").select("src", "tgt")
    if not distinct:
        ends, _ = cut(ends.repartition(parts, "src").distinct(), by="src", parts=parts)
    found, whole = _peeled(ends, parts)
    if whole:
        return found.select("node", F.col("node").alias("component"), "layer")
    # What leads nowhere but out of cycles is peeled from the other end; the rest lies on cycles or between them.
    keep = lambda frame, end: frame.withColumnRenamed("node", end)
    steps = ends.filter("src <> tgt")
    rest, _ = cut(steps.repartition(parts, "tgt").select(F.col("tgt").alias("node")).distinct().join(found, "node", "left_anti"), by="node", parts=parts)
    inner = steps.join(keep(rest, "src"), "src", "left_semi").repartition(parts, "tgt").join(keep(rest, "tgt"), "tgt", "left_semi")
    inner, _ = cut(inner.select("src", "tgt"), by="tgt", parts=parts)
    after, _ = _peeled(inner.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), parts)
    core, _ = cut(rest.join(after, "node", "left_anti"))
    knots = inner.join(keep(core, "tgt"), "tgt", "left_semi").repartition(parts, "src").join(keep(core, "src"), "src", "left_semi")
    knots, _ = cut(knots.select("src", "tgt"), by="src", parts=parts)
    strong, _ = cut(strong_components(core, knots).repartition(parts, "node"), by="node", parts=parts)
    # The graph of components; edges within one only name it. Nodes off all cycles are components of their own.
    of = lambda end: strong.withColumnsRenamed({"node": end, "component": f"{end}_component"})
    known = lambda end: F.coalesce(f"{end}_component", end).alias(end)
    between = ends.join(of("src"), "src", "left").join(of("tgt"), "tgt", "left").select(known("src"), known("tgt"))
    between, _ = cut(between.repartition(parts, "src").distinct(), by="src", parts=parts)
    layer = _peeled(between, parts)[0].withColumnRenamed("node", "component")
    nodes = found.select("node").unionByName(rest).join(strong, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return nodes.join(layer, "component").select("node", "component", "layer")
