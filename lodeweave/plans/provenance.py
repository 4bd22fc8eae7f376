"""Provenance queries over the sample catalog, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.scalars import database_of
from lodeweave.operators import components, graph, traverse
from lodeweave.sources.catalog_views import SQL, Frames
from lodeweave.sources.scratch import cut

QUERIES, ORACLES = {}, {}
DEPTH = 5
#: The source, and the target, of most active edges; ties go to the least name.
TOP = {"downstream": ("src", "source_dataset", "source_field"), "upstream": ("tgt", "target_dataset", "target_field")}


def sql(body: str, views: bool = True) -> str:
    return f"WITH RECURSIVE {SQL.strip()}{body}" if views else body


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def _active(spark: SparkSession, d: str, way: str = "downstream") -> DataFrame:
    """Active edges, in buckets of the end that steps of the direction start from."""
    return traverse.active(Frames(spark, d).toward(way))


def _ends(edges: DataFrame) -> DataFrame:
    """What a walk whose edges are only counted carries from level to level."""
    return edges.select("provenance_id", "src", "tgt")


def busiest(edges: DataFrame, end: str) -> DataFrame:
    top = edges.groupBy(F.col(end).alias("root")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(1)
    return cut(top.select("root"))[0]


def _walk_sql(way: str, rule: str = "node", depth: int = DEPTH, anchor: str | None = None) -> str:
    near, far = ("src", "tgt") if way == "downstream" else ("tgt", "src")
    new = f"e.{far}" if rule == "node" else "e.provenance_id"
    path = f"[e.{near}, e.{far}]" if rule == "node" else "[e.provenance_id]"
    anchor = anchor or f"(SELECT {near} FROM act GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    return f"""act AS (SELECT * FROM ol_column_provenance WHERE is_active = 'Y'),
walk_{way} AS (
  SELECT e.{near} AS root, e.*, 1 AS depth, {path} AS path FROM act e WHERE e.{near} IN {anchor}
  UNION ALL
  SELECT w.root, e.*, w.depth + 1, list_append(w.path, {new}) FROM walk_{way} w JOIN act e ON e.{near} = w.{far} WHERE w.depth < {depth} AND NOT list_contains(w.path, {new}))"""


_EDGES = "root, source_dataset, source_field, target_dataset, target_field, transformation_type"


def _edge_set(spark: SparkSession, d: str, way: str, rule: str = "node") -> DataFrame:
    e = _active(spark, d, way)
    found = traverse.edges_of(traverse.walk(e, busiest(e, TOP[way][0]), direction=way, max_depth=DEPTH, rule=rule))
    return found.select("root", "source_dataset", "source_field", "target_dataset", "target_field", "transformation_type", "depth")


@query(f", {_walk_sql('downstream')} SELECT {_EDGES}, min(depth) AS depth FROM walk_downstream GROUP BY ALL")
def provenance_field_downstream(spark, d):
    return _edge_set(spark, d, "downstream")


@query(f", {_walk_sql('upstream')} SELECT {_EDGES}, min(depth) AS depth FROM walk_upstream GROUP BY ALL")
def provenance_field_upstream(spark, d):
    return _edge_set(spark, d, "upstream")


_BOTH_ROOT = "(SELECT node FROM (SELECT src AS node FROM act UNION ALL SELECT tgt FROM act) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_BOTH = f", {_walk_sql('downstream', anchor=_BOTH_ROOT)}, {_walk_sql('upstream', anchor=_BOTH_ROOT).split(chr(10), 1)[1]}"


def _hub(e: DataFrame) -> DataFrame:
    ends = e.select(F.explode(F.array("src", "tgt")).alias("root")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return cut(ends.orderBy(F.desc("n"), "root").limit(1).select("root"))[0]


def _both(spark, d):
    e = _active(spark, d)
    root = _hub(e)
    return root, {w: traverse.edges_of(traverse.walk(_active(spark, d, w), root, direction=w, max_depth=DEPTH)) for w in ("upstream", "downstream")}


@query(_BOTH + f""" SELECT DISTINCT {_EDGES}, 'downstream' AS direction FROM walk_downstream UNION ALL SELECT DISTINCT {_EDGES}, 'upstream' FROM walk_upstream""")
def provenance_field_both(spark, d):
    _, found = _both(spark, d)
    cols = ["root", "source_dataset", "source_field", "target_dataset", "target_field", "transformation_type"]
    return found["downstream"].select(*cols, F.lit("downstream").alias("direction")).union(found["upstream"].select(*cols, F.lit("upstream").alias("direction")))


@query(_BOTH + f""" SELECT DISTINCT node FROM (SELECT unnest([src, tgt]) AS node FROM walk_downstream UNION ALL SELECT unnest([src, tgt]) FROM walk_upstream UNION ALL SELECT * FROM {_BOTH_ROOT})""")
def provenance_nodes(spark, d):
    """The root is a node even without edges."""
    root, found = _both(spark, d)
    return found["downstream"].select("src", "tgt").union(found["upstream"].select("src", "tgt")).select(F.explode(F.array("src", "tgt")).alias("node")).union(root).distinct()


_TABLE = "(SELECT source_dataset FROM act GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f", {_walk_sql('downstream', depth=3, anchor='(SELECT src FROM act WHERE source_dataset = ' + _TABLE + ')')} SELECT {_EDGES}, min(depth) AS depth FROM walk_downstream GROUP BY ALL")
def provenance_table(spark, d):
    """All fields of the table with most edges in one traversal: each path carries its root."""
    e = _active(spark, d)
    top = e.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_dataset").limit(1)
    roots = e.join(F.broadcast(top.select("source_dataset")), "source_dataset").select(F.col("src").alias("root")).distinct()
    found = traverse.edges_of(traverse.walk(e, roots, max_depth=3))
    return found.select("root", "source_dataset", "source_field", "target_dataset", "target_field", "transformation_type", "depth")


@query(f", {_walk_sql('downstream', rule='edge')} SELECT count(DISTINCT provenance_id) AS edges, count(*) AS row_count, max(depth) AS max_depth, count(DISTINCT tgt) AS targets FROM walk_downstream")
def pattern_counts(spark, d):
    e = _ends(_active(spark, d))
    w = traverse.walk(e, busiest(e, "src"), rule="edge", max_depth=DEPTH)
    return w.agg(F.count_distinct("provenance_id").alias("edges"), F.count(F.lit(1)).alias("row_count"), F.max("depth").alias("max_depth"), F.count_distinct("tgt").alias("targets"))


@query(_BOTH.replace("NOT list_contains(w.path, e.tgt)", "NOT list_contains(w.path, e.provenance_id)").replace("NOT list_contains(w.path, e.src)", "NOT list_contains(w.path, e.provenance_id)").replace("list_append(w.path, e.tgt)", "list_append(w.path, e.provenance_id)").replace("list_append(w.path, e.src)", "list_append(w.path, e.provenance_id)").replace("[e.src, e.tgt]", "[e.provenance_id]").replace("[e.tgt, e.src]", "[e.provenance_id]") + " SELECT DISTINCT provenance_id FROM (SELECT provenance_id FROM walk_downstream UNION SELECT provenance_id FROM walk_upstream)")
def pattern_bidirectional(spark, d):
    e = _active(spark, d)
    root = _hub(e)
    ways = [traverse.walk(_ends(_active(spark, d, w)), root, direction=w, rule="edge", max_depth=DEPTH).select("provenance_id") for w in ("upstream", "downstream")]
    return ways[0].union(ways[1]).distinct()


@query(", " + _walk_sql("downstream", depth=3, anchor="(SELECT src FROM act)") + " SELECT depth, count(*) AS paths, count(DISTINCT provenance_id) AS edges FROM walk_downstream GROUP BY depth")
def closure_max_depth(spark, d):
    """Every edge is an anchor: the closure to depth 3, summed by depth."""
    e = _ends(_active(spark, d))
    w = traverse.walk(e, e.select(F.col("src").alias("root")).distinct(), max_depth=3)
    return w.groupBy("depth").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("provenance_id").alias("edges"))


@query(", " + _walk_sql("downstream", anchor="('NOWHERE.T0.P0')") + f" SELECT {_EDGES}, depth FROM walk_downstream")
def provenance_missing_root(spark, d):
    e = _active(spark, d)
    roots = spark.createDataFrame([("NOWHERE.T0.P0",)], "root string")
    return traverse.edges_of(traverse.walk(e, roots)).select("root", "source_dataset", "source_field", "target_dataset", "target_field", "transformation_type", "depth")


def _bench(way: str, depth: int):
    near = TOP[way][0]

    def run(spark, d):
        e = _ends(_active(spark, d, way))
        w = traverse.walk(e, busiest(e, near), direction=way, rule="edge", max_depth=depth)
        size = F.aggregate("path", F.lit(0), lambda a, x: a + F.length(x)) + (F.size("path") - 1) * 2
        return w.agg(F.count(F.lit(1)).alias("row_count"), F.max("depth").alias("max_depth"), F.round(F.avg(size), 4).alias("avg_path_chars"))

    run.__name__ = f"bench_{way}_{depth}"
    query(f", {_walk_sql(way, rule='edge', depth=depth)} SELECT count(*) AS row_count, max(depth) AS max_depth, round(avg(length(array_to_string(path, '->'))), 4) AS avg_path_chars FROM walk_{way}")(run)


for _w in ("downstream", "upstream"):
    for _n in (5, 10):
        _bench(_w, _n)

_REACH = """act AS (SELECT * FROM ol_column_provenance WHERE is_active = 'Y'),
reach_{way} AS (
  SELECT {near} AS root, {far} AS node, 1 AS depth FROM act WHERE {near} = {root}
  UNION
  SELECT r.root, e.{far}, r.depth + 1 FROM reach_{way} r JOIN act e ON e.{near} = r.node WHERE r.depth < 10),
least_{way} AS (SELECT root, node, min(depth) AS depth FROM reach_{way} WHERE node <> root GROUP BY ALL)"""
_DOWN = _REACH.format(way="down", near="src", far="tgt", root=_BOTH_ROOT)
_UP = _REACH.format(way="up", near="tgt", far="src", root=_BOTH_ROOT)
_UPDOWN = _DOWN + ", " + _UP.split("\n", 1)[1]


def _reach(spark, d, way):
    return traverse.reach(_active(spark, d, way), _hub(_active(spark, d)), direction=way)


@query(f", {_DOWN} SELECT * FROM least_down")
def reachable_downstream(spark, d):
    return _reach(spark, d, "downstream")


@query(f", {_UP} SELECT * FROM least_up")
def reachable_upstream(spark, d):
    return _reach(spark, d, "upstream")


@query(f", {_DOWN} SELECT split_part(node, '.', 1) AS database, node, depth FROM least_down")
def downstream_list(spark, d):
    return _reach(spark, d, "downstream").select(database_of(F.col("node")).alias("database"), "node", "depth")


@query(f", {_UP} SELECT split_part(node, '.', 1) AS database, node, depth FROM least_up")
def upstream_list(spark, d):
    return _reach(spark, d, "upstream").select(database_of(F.col("node")).alias("database"), "node", "depth")


_HIGH = f", {_UPDOWN}, high AS (SELECT root, node FROM least_down UNION SELECT root, node FROM least_up UNION SELECT n, n FROM {_BOTH_ROOT} AS t(n))"


@query(_HIGH + " SELECT root, node FROM high")
def highlight_nodes(spark, d):
    e = _active(spark, d)
    return graph.highlight(e, _hub(e), by_target=_active(spark, d, "upstream"))


@query(_HIGH + " SELECT provenance_id, src, tgt FROM act WHERE src IN (SELECT node FROM high) AND tgt IN (SELECT node FROM high)")
def highlight_edges(spark, d):
    e = _active(spark, d)
    return graph.induced(e, graph.highlight(e, _hub(e), by_target=_active(spark, d, "upstream"))).select("provenance_id", "src", "tgt")


@query(_HIGH + " SELECT DISTINCT regexp_extract(node, '^(.*)\\.[^.]*$', 1) AS dataset FROM high")
def selection_tables(spark, d):
    e = _active(spark, d)
    return graph.highlight(e, _hub(e), by_target=_active(spark, d, "upstream")).select(F.regexp_extract("node", r"^(.*)\.[^.]*$", 1).alias("dataset")).distinct()


_IMPACT = f", {_DOWN}, imp AS (SELECT root, node, depth, split_part(node, '.', 1) AS database, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS impact_type, regexp_matches(split_part(node, '.', 2), '^T[0-9]*7$') AS critical FROM least_down)"
_CRITICAL = r"^T[0-9]*7$"


def _impact(spark, d):
    e = _active(spark, d)
    return graph.impact(e, _hub(e), critical=_CRITICAL)


@query(_IMPACT + " SELECT * FROM imp")
def impact_assets(spark, d):
    return _impact(spark, d)


@query(_IMPACT + " SELECT count(*) AS total, count(*) FILTER (WHERE critical) AS critical_count, count(*) FILTER (WHERE impact_type = 'direct') AS direct, max(depth) AS max_depth FROM imp")
def impact_summary(spark, d):
    return _impact(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if("critical").alias("critical_count"), F.count_if(F.col("impact_type") == "direct").alias("direct"), F.max("depth").alias("max_depth"))


@query(_IMPACT + " SELECT depth, count(*) AS assets FROM imp GROUP BY depth")
def impact_by_depth(spark, d):
    return _impact(spark, d).groupBy("depth").agg(F.count(F.lit(1)).alias("assets"))


@query(_IMPACT + " SELECT database, count(*) AS assets FROM imp GROUP BY database")
def impact_by_database(spark, d):
    return _impact(spark, d).groupBy("database").agg(F.count(F.lit(1)).alias("assets"))


@query(""", act AS (SELECT * FROM ol_column_provenance WHERE is_active = 'Y'), both_ways AS (SELECT src, tgt FROM act UNION SELECT tgt, src FROM act),
comp AS (SELECT n AS root, n AS node FROM """ + _BOTH_ROOT + """ AS t(n) UNION SELECT c.root, b.tgt FROM comp c JOIN both_ways b ON b.src = c.node) SELECT count(*) AS nodes, min(node) AS first_node, max(node) AS last_node FROM comp""")
def weak_component(spark, d):
    e = _active(spark, d)
    return graph.weak_component(e, _hub(e)).agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))


@query(""", act AS (SELECT * FROM ol_column_provenance WHERE is_active = 'Y'), near AS (SELECT src AS a, tgt AS b FROM act UNION SELECT tgt, src FROM act),
comp(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM near GROUP BY a
  UNION SELECT c.node, min(o.component) FROM recurring.comp c JOIN near ON a = c.node JOIN comp o ON o.node = b WHERE o.component < c.component GROUP BY c.node) SELECT node, component FROM comp""")
def weak_components(spark, d):
    """Every column with the least column that it is connected to when directions are ignored."""
    return components.weak_components(_active(spark, d))


@query(""", act AS (SELECT DISTINCT src, tgt FROM ol_column_provenance WHERE is_active = 'Y'), leads(a, b) AS (SELECT src, tgt FROM act UNION SELECT a, tgt FROM leads JOIN act ON src = b),
knot AS (SELECT x.a AS node, min(x.b) AS component FROM leads x JOIN leads y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
member AS (SELECT node, least(node, coalesce(component, node)) AS component FROM (SELECT src AS node FROM act UNION SELECT tgt FROM act) LEFT JOIN knot USING (node)),
step AS (SELECT DISTINCT s.component AS s, t.component AS t FROM act JOIN member s ON s.node = src JOIN member t ON t.node = tgt WHERE s.component <> t.component),
lay(component, layer) USING KEY (component) AS (SELECT DISTINCT component, 0 FROM member
  UNION SELECT t, max(l.layer) + 1 FROM lay l JOIN step ON s = l.component JOIN recurring.lay o ON o.component = t WHERE l.layer + 1 > o.layer GROUP BY t)
SELECT node, component, layer FROM member JOIN lay USING (component)""")
def component_layers(spark, d):
    """Every column with its strong component and the longest path that leads to it, cycles counting as one node, without a bound on depth."""
    return components.layers(_active(spark, d), distinct=True, parts=Frames(spark, d).parts)


# Generated graphs are as large as the sample's tables: as many columns as there are parts, as broad as there are suppliers.


def _rows(spark: SparkSession, d: str, name: str) -> int:
    return Frames(spark, d).table(name).count()


def gen_layered_graph(spark, d):
    """Ten layers of columns, each feeding its counterpart and its neighbour in the next."""
    g = graph.layered_edges(spark, _rows(spark, d, "part"), 10)
    return g.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("tgt").alias("targets"), F.min("src").alias("first_source"))


def _layers_sql(sizes: str, nodes: str, width: str, second: str, second_type: str, name: str) -> str:
    """Edges of the nodes (layer, i): one for each of two hops, the second under a condition. ``sizes``: nodes and per (columns in a layer)."""
    full = f"'{name}_' || (({{0}}) * per + {{1}}) || '.col_' || ({{0}}) || '_' || {{1}}"
    kind = "CASE i % 4 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'DERIVED' WHEN 2 THEN 'AGGREGATED' ELSE 'JOINED' END"
    return f"""WITH sizes AS ({sizes}), n AS (SELECT r // per AS layer, r % per AS i, per, nodes FROM sizes, range(0, (SELECT {nodes} FROM sizes)) t(r)), w AS (SELECT *, {width} AS width FROM n),
h AS (SELECT layer, i, per, i % width AS j, {kind} AS transformation_type FROM w WHERE width > 0 UNION ALL SELECT layer, i, per, (i + 1) % width, '{second_type}' FROM w WHERE width > 0 AND {second})
SELECT {full.format('layer', 'i')} AS src, {full.format('layer + 1', 'j')} AS tgt, transformation_type FROM h"""


def gen_square_graph(spark, d):
    """As many columns as there are parts, in about as many layers as columns in a layer."""
    return graph.square_edges(spark, _rows(spark, d, "part"))


def gen_depth_breadth_graph(spark, d):
    """Twenty layers, each as broad as there are suppliers."""
    return graph.depth_breadth_edges(spark, 20, _rows(spark, d, "supplier"))


def gen_single_database_graph(spark, d):
    """A chain of tables of five columns, as many columns as there are parts."""
    return graph.single_database_edges(spark, _rows(spark, d, "part"))


_SQUARE = "SELECT nodes, greatest(1, CAST(ceil(nodes / greatest(2, CAST(floor(sqrt(nodes)) AS BIGINT))) AS BIGINT)) AS per FROM (SELECT count(*) AS nodes FROM part)"
_TABLES = "range(0, (SELECT greatest(0, CAST(ceil(count(*) / 5.0) AS BIGINT) - 1) FROM part)) r(t)"
QUERIES |= {f.__name__: f for f in (gen_layered_graph, gen_square_graph, gen_depth_breadth_graph, gen_single_database_graph)}
ORACLES |= {
    "gen_layered_graph": """WITH p AS (SELECT greatest(1, count(*) // 10) AS per FROM part) SELECT count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT tgt) AS targets, min(src) AS first_source FROM (
  SELECT DISTINCT 'L' || (r // per) || '.T.c' || (r % per) AS src, 'L' || (r // per + 1) || '.T.c' || ((r % per + s) % per) AS tgt FROM p, range(0, (SELECT 9 * per FROM p)) t(r), (VALUES (0), (1)) v(s))""",
    "gen_square_graph": _layers_sql(_SQUARE, "nodes", "least(per, nodes - (layer + 1) * per)", "i % 3 = 0 AND width > 1", "DERIVED", "benchmark_db.TABLE"),
    "gen_depth_breadth_graph": _layers_sql("SELECT count(*) AS per, 20 * count(*) AS nodes FROM supplier", "19 * per", "per", "i > 0 AND i % 2 = 0", "JOINED", "layered_db.TBL"),
    "gen_single_database_graph": f"""SELECT 'single_db.FACT_' || t || '.field_0' AS src, 'single_db.FACT_' || (t + 1) || '.field_0' AS tgt, CASE t % 3 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'DERIVED' ELSE 'AGGREGATED' END AS transformation_type FROM {_TABLES}
UNION ALL SELECT 'single_db.FACT_' || t || '.field_0', 'single_db.FACT_' || t || '.field_1', 'DERIVED' FROM {_TABLES}""",
}


@query(", " + """act AS (SELECT * FROM ol_column_provenance WHERE is_active = 'Y'),
lay AS (SELECT n AS node, 0 AS layer FROM (SELECT src AS n FROM act GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) UNION SELECT e.tgt, l.layer + 1 FROM lay l JOIN act e ON e.src = l.node WHERE l.layer < 6)
SELECT node, max(layer) AS layer FROM lay GROUP BY node""")
def layer_rank(spark, d):
    e = _active(spark, d)
    return graph.layer_rank(e, busiest(e, "src"), 6)


@query(f""", {_walk_sql('downstream')} SELECT source_dataset AS source_table, source_field, target_dataset AS target_table, target_field, transformation_type, min(depth) AS depth FROM walk_downstream GROUP BY ALL""")
def edge_table_depth(spark, d):
    """The table of the edges that a column feeds, each with its depth."""
    e = _active(spark, d)
    found = traverse.edges_of(traverse.walk(e, busiest(e, TOP["downstream"][0]), max_depth=DEPTH).drop("root"))
    return found.select(F.col("source_dataset").alias("source_table"), "source_field", F.col("target_dataset").alias("target_table"), "target_field", "transformation_type", "depth")
