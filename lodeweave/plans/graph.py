"""Queries over the whole provenance graph: degrees, tables of edges, database provenance, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import scalars as S
from lodeweave.operators import graph, serve, tables, traverse
from lodeweave.plans.base import Registry
from lodeweave.sources.catalog_views import Frames

R = Registry()
query, QUERIES, ORACLES = R.query, R.queries, R.oracles

# The databases with the most datasets: which there are is the data's.
_TOP = ", tops AS (SELECT db, row_number() OVER (ORDER BY n DESC, db) AS r FROM (SELECT split_part(name, '.', 1) AS db, count(*) AS n FROM ol_dataset GROUP BY 1)), top1 AS (SELECT db FROM tops WHERE r = 1)"
_OWN = "(SELECT db || '.' FROM top1)"
_ACT = ", act AS (SELECT * FROM ol_column_provenance WHERE is_active = 'Y')"
_DB = "split_part({}, '.', 1)"


def _largest(spark, d, n=1):
    """Names of the n databases with the most datasets."""
    c = Frames(spark, d).dataset.groupBy(S.database_of(F.col("name")).alias("db")).agg(F.count(F.lit(1)).alias("n"))
    return [r["db"] for r in c.orderBy(F.desc("n"), "db").limit(n).collect()]


def _act(spark, d):
    return traverse.active(Frames(spark, d).edges)


# ---- degrees and neighbours


@query(_ACT + """, e AS (SELECT src AS node, 0 AS i, 1 AS o FROM act UNION ALL SELECT tgt, 1, 0 FROM act) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM e GROUP BY node""")
def column_degrees(spark, d):
    return graph.degrees(_act(spark, d))


@query(_ACT + """, n AS (SELECT src AS node FROM act UNION SELECT tgt FROM act) SELECT node, node IN (SELECT tgt FROM act) AS has_upstream, node IN (SELECT src FROM act) AS has_downstream FROM n""")
def column_provenance_flags(spark, d):
    return graph.provenance_flags(_act(spark, d))


@query(_ACT + " SELECT src, string_agg(DISTINCT tgt, ',' ORDER BY tgt) AS targets FROM act GROUP BY src")
def adjacency_lists(spark, d):
    return graph.adjacency(_act(spark, d)).select("src", F.array_join("targets", ",").alias("targets"))


@query(_ACT + " SELECT DISTINCT src AS node FROM act WHERE src NOT IN (SELECT tgt FROM act)")
def source_columns(spark, d):
    e = _act(spark, d)
    return e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("tgt").alias("node")), "node", "left_anti")


@query(_ACT + " SELECT DISTINCT tgt AS node FROM act WHERE tgt NOT IN (SELECT src FROM act)")
def leaf_columns(spark, d):
    e = _act(spark, d)
    return e.select(F.col("tgt").alias("node")).distinct().join(e.select(F.col("src").alias("node")), "node", "left_anti")


@query(_ACT + " SELECT count(DISTINCT source_dataset || '.' || source_field) AS sources, count(DISTINCT target_dataset || '.' || target_field) AS targets FROM act")
def upstream_node_count(spark, d):
    return _act(spark, d).agg(F.count_distinct("src").alias("sources"), F.count_distinct("tgt").alias("targets"))


# ---- groups of columns and tables


@query(""" SELECT s.name, count(*) AS columns, string_agg(field_name, ',' ORDER BY ordinal_position, field_name) AS names FROM ol_dataset s JOIN ol_dataset_field USING (dataset_id) GROUP BY s.name""")
def group_columns_by_table(spark, d):
    c = Frames(spark, d)
    return tables.columns_of_tables(c.dataset, c.field).select("name", F.size("columns").cast("long").alias("columns"), F.array_join("columns.field_name", ",").alias("names"))


@query(""" SELECT split_part(name, '.', 1) AS database, count(*) AS tables, min(name) AS first_table, max(name) AS last_table, count(*) FILTER (WHERE source_type = 'VIEW') AS views FROM ol_dataset GROUP BY 1""")
def database_clusters(spark, d):
    return graph.database_clusters(Frames(spark, d).dataset)


@query(_ACT + f""" SELECT {_DB.format('source_dataset')} AS source_database, {_DB.format('target_dataset')} AS target_database, count(*) AS edges,
bool_or({_DB.format('source_dataset')} <> {_DB.format('target_dataset')}) AS crosses FROM act GROUP BY 1, 2""")
def cross_database_edges(spark, d):
    return graph.cross_database(_act(spark, d))


@query(""", n AS (SELECT s.name, count(*) AS c, max(length(field_name)) AS longest FROM ol_dataset s JOIN ol_dataset_field USING (dataset_id) GROUP BY s.name)
SELECT name, CAST(least(greatest(200, 60 + 8 * greatest(length(name), longest)), 400) AS INTEGER) AS width, 40 + 28 * c AS height, c >= 200 AS large FROM n""")
def table_node_geometry(spark, d):
    c = Frames(spark, d)
    return tables.geometry(c.dataset, c.field)


@query(_ACT + ", n AS (SELECT count(*) AS nodes FROM (SELECT src FROM act UNION SELECT tgt FROM act)) SELECT nodes, nodes >= 200 AS large, CASE WHEN nodes >= 200 THEN greatest(3, 5 - 2) ELSE 5 END AS suggested_depth FROM n")
def large_graph_flag(spark, d):
    return tables.large_graph(graph.nodes_of(_act(spark, d)), 5)


# ---- edges as a table

_EDGE_TABLE = _ACT + """, t AS (SELECT e.provenance_id, coalesce(s.name, source_dataset) AS source_table, source_field, coalesce(t.name, target_dataset) AS target_table, target_field, transformation_type, confidence_score
FROM act e LEFT JOIN ol_dataset s ON s.name = source_dataset LEFT JOIN ol_dataset t ON t.name = target_dataset)"""


def _edge_table(spark, d):
    return tables.edge_table(_act(spark, d), Frames(spark, d).dataset)


@query(_EDGE_TABLE + " SELECT * FROM t")
def edge_table(spark, d):
    return _edge_table(spark, d)


_HAS = "contains(lower({}), (SELECT lower(db) FROM top1))"


@query(_TOP + _EDGE_TABLE + f" SELECT * FROM t WHERE {' OR '.join(_HAS.format(c) for c in ('source_table', 'source_field', 'target_table', 'target_field', 'transformation_type'))}")
def edge_table_filter(spark, d):
    return tables.matching(_edge_table(spark, d), _largest(spark, d)[0].capitalize())


@query(_EDGE_TABLE + " SELECT * FROM t ORDER BY coalesce(confidence_score, -1) DESC, provenance_id LIMIT 100")
def edge_table_sorted(spark, d):
    return tables.ordered(_edge_table(spark, d), "confidence_score", descending=True).limit(100)


@query(_EDGE_TABLE + " SELECT * FROM t ORDER BY coalesce(confidence_score, -1) DESC, provenance_id")
def edge_table_sorted_all(spark, d):
    """The whole table in order; edge_table_sorted is its first 100 rows, as its SQL says."""
    return tables.ordered(_edge_table(spark, d), "confidence_score", descending=True)


@query(_EDGE_TABLE + " SELECT * FROM t ORDER BY source_table, provenance_id LIMIT 25 OFFSET 50")
def edge_table_page(spark, d):
    return tables.ordered(_edge_table(spark, d), "source_table").offset(50).limit(25)


@query(_EDGE_TABLE + " SELECT t.* FROM t WHERE source_table IN (SELECT name FROM ol_dataset WHERE source_type = 'VIEW') AND target_table IN (SELECT name FROM ol_dataset WHERE source_type = 'VIEW')")
def asset_type_filter(spark, d):
    """Edges whose two tables are of the chosen types."""
    return tables.between_types(_edge_table(spark, d), Frames(spark, d).dataset, ["VIEW"])


_PCT = "CAST(round(confidence_score * 100) AS INTEGER)"


@query(f""" SELECT confidence_score, count(*) AS edges, {_PCT} AS pct, CASE WHEN {_PCT} >= 90 THEN 'high' WHEN {_PCT} >= 70 THEN 'medium' WHEN {_PCT} >= 50 THEN 'low' ELSE 'very_low' END AS band,
CAST(CASE WHEN {_PCT} >= 90 THEN 1.0 WHEN {_PCT} >= 70 THEN 0.9 WHEN {_PCT} >= 50 THEN 0.8 ELSE 0.7 END AS DOUBLE) AS opacity FROM ol_column_provenance GROUP BY confidence_score""")
def confidence_bands(spark, d):
    n = Frames(spark, d).edges.groupBy("confidence_score").agg(F.count(F.lit(1)).alias("edges"))
    c = F.col("confidence_score")
    return n.withColumns({"pct": S.percent(c), "band": S.confidence_band(c), "opacity": S.confidence_opacity(c)})


_COLOURS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.EDGE_COLOURS.items())


@query(f" SELECT transformation_type, upper(substr(transformation_type, 1, 1)) || lower(substr(transformation_type, 2)) AS label, CASE lower(transformation_type) {_COLOURS} ELSE '{S.OTHER_COLOUR}' END AS colour, count(*) AS edges FROM ol_column_provenance GROUP BY transformation_type")
def edge_styles(spark, d):
    n = Frames(spark, d).edges.groupBy("transformation_type").agg(F.count(F.lit(1)).alias("edges"))
    return n.withColumns({"label": F.initcap(F.lower("transformation_type")), "colour": S.edge_colour(F.col("transformation_type"))})


@query(" SELECT min(confidence_score) AS least, max(confidence_score) AS greatest, count(*) FILTER (WHERE confidence_score NOT BETWEEN 0 AND 1) AS outside FROM ol_column_provenance")
def confidence_range(spark, d):
    return Frames(spark, d).edges.agg(F.min("confidence_score").alias("least"), F.max("confidence_score").alias("greatest"), F.count_if(~F.col("confidence_score").between(0, 1)).alias("outside"))


@query(_TOP + " SELECT count(*) AS row_count, count(*) FILTER (WHERE is_active = 'Y') AS active_rows, count(*) FILTER (WHERE contains(source_dataset, (SELECT db FROM top1))) AS test_rows FROM ol_column_provenance")
def provenance_table_stats(spark, d):
    return Frames(spark, d).edges.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("is_active") == "Y").alias("active_rows"), F.count_if(F.col("source_dataset").contains(_largest(spark, d)[0])).alias("test_rows"))


@query(_ACT + " SELECT DISTINCT source_dataset, target_dataset FROM act")
def table_provenance(spark, d):
    return _act(spark, d).select("source_dataset", "target_dataset").distinct()


# ---- database provenance

_IN = f"(starts_with(source_dataset, {_OWN}) OR starts_with(target_dataset, {_OWN}))"


@query(_TOP + _ACT + f" SELECT provenance_id, src, tgt, transformation_type, 1 AS depth FROM act WHERE {_IN}")
def database_provenance(spark, d):
    """Edges with an end in the database: what a recursion that is never entered returns."""
    return graph.touching(_act(spark, d), _largest(spark, d)[0]).select("provenance_id", "src", "tgt", "transformation_type", F.lit(1).alias("depth"))


@query(_TOP + _ACT + f""", n AS (SELECT s.name || '.' || field_name AS node, field_type, coalesce(nullable = 'Y', false) AS nullable, coalesce(source_type, 'TABLE') AS source_type, true AS own
FROM ol_dataset s JOIN ol_dataset_field USING (dataset_id) WHERE starts_with(s.name, {_OWN})),
x AS (SELECT DISTINCT node, ds FROM (SELECT src AS node, source_dataset AS ds FROM act WHERE {_IN} UNION ALL SELECT tgt, target_dataset FROM act WHERE {_IN}) WHERE NOT starts_with(ds, {_OWN}))
SELECT * FROM n UNION ALL SELECT node, f.field_type, coalesce(f.nullable = 'Y', false), coalesce(s.source_type, 'TABLE'), false
FROM x LEFT JOIN ol_dataset s ON s.name = ds LEFT JOIN ol_dataset_field f ON f.dataset_id = s.dataset_id AND f.field_name = substr(node, length(ds) + 2)""")
def database_nodes(spark, d):
    """All fields of the database and the outer ends of its edges, with their types."""
    c = Frames(spark, d)
    return graph.database_nodes(traverse.active(c.edges), c.dataset, c.field, _largest(spark, d)[0])


@query(_TOP + _ACT + f""", sides AS (SELECT src AS here, tgt AS nxt, provenance_id FROM act UNION ALL SELECT tgt, src, provenance_id FROM act),
grow AS (SELECT DISTINCT node, 0 AS depth FROM (SELECT src AS node FROM act WHERE starts_with(source_dataset, {_OWN}) UNION ALL SELECT tgt FROM act WHERE starts_with(target_dataset, {_OWN}))
  UNION SELECT s.nxt, g.depth + 1 FROM grow g JOIN sides s ON s.here = g.node WHERE g.depth < 3),
near AS (SELECT node, min(depth) AS depth FROM grow GROUP BY node)
SELECT provenance_id, CAST(min(depth) + 1 AS INTEGER) AS depth FROM near JOIN sides ON here = node WHERE depth < 3 GROUP BY provenance_id""")
def database_provenance_expanded(spark, d):
    """Edges within three steps of the database, in both directions."""
    return graph.expand_database(_act(spark, d), _largest(spark, d)[0], direction="both", max_depth=3, by_target=traverse.active(Frames(spark, d).edges_by_target))


_PAGE = """, ranked AS (SELECT *, dense_rank() OVER (ORDER BY source_dataset) AS r FROM act {where}), total AS (SELECT count(DISTINCT source_dataset) AS n FROM act {where})
SELECT provenance_id, src, tgt, n AS total_tables, CAST(ceil(n / {size}.0) AS BIGINT) AS total_pages, n > {page} * {size} AS has_next FROM ranked, total WHERE r > ({page} - 1) * {size} AND r <= {page} * {size}"""


@query(_TOP + _ACT + _PAGE.format(where=f"WHERE starts_with(source_dataset, {_OWN})", page=1, size=2))
def database_provenance_page(spark, d):
    """A page of tables of a database, with their edges."""
    return graph.page_by_tables(_act(spark, d).filter(F.col("source_dataset").startswith(_largest(spark, d)[0] + ".")), page=1, size=2)


@query(_TOP + _ACT + _PAGE.format(where="WHERE split_part(source_dataset, '.', 1) IN (SELECT db FROM tops WHERE r <= 3)", page=2, size=3))
def all_db_provenance_filtered(spark, d):
    """A page of tables of the chosen databases; no choice means all."""
    return graph.page_by_tables(graph.of_databases(_act(spark, d), _largest(spark, d, 3)), page=2, size=3)


@query(_ACT + """, t AS (SELECT DISTINCT source_dataset FROM act ORDER BY 1 LIMIT 4) SELECT DISTINCT src, tgt FROM act WHERE source_dataset IN (SELECT * FROM t)""")
def merge_pages(spark, d):
    """Two pages as one graph: an edge that both have counts once."""
    e = _act(spark, d)
    pages = [graph.page_by_tables(e, page=p, size=2) for p in (1, 2, 2)]
    return pages[0].union(pages[1]).union(pages[2]).dropDuplicates(["src", "tgt"]).select("src", "tgt")


# ---- integrity


def _integrity(name: str, oracle: str, build) -> None:
    def run(spark, d):
        return build(Frames(spark, d))

    run.__name__ = f"integrity_{name}"
    query(oracle)(run)


_ENDS = """, known AS (SELECT s.name || '.' || field_name AS node FROM ol_dataset s JOIN ol_dataset_field USING (dataset_id) WHERE ordinal_position % 10 <> 0)"""


def _known(c: Frames):
    """Registered columns, but each tenth of a table: so that there are orphans to find."""
    return graph.catalog_nodes(c.dataset, c.field.filter("ordinal_position % 10 <> 0"))


_integrity("orphan_sources", _ENDS + " SELECT provenance_id, src FROM ol_column_provenance WHERE src NOT IN (SELECT node FROM known)", lambda c: graph.orphans(c.edges, _known(c), "src"))
_integrity("orphan_targets", _ENDS + " SELECT provenance_id, tgt FROM ol_column_provenance WHERE tgt NOT IN (SELECT node FROM known)", lambda c: graph.orphans(c.edges, _known(c), "tgt"))
_integrity(
    "orphan_fields",
    " SELECT field_id FROM ol_dataset_field WHERE dataset_id NOT IN (SELECT dataset_id FROM ol_dataset WHERE suppkey % 6 <> 0)",
    lambda c: c.field.join(c.dataset.filter("suppkey % 6 <> 0").select("dataset_id"), "dataset_id", "left_anti").select("field_id"),
)
_integrity(
    "orphan_datasets",
    " SELECT dataset_id FROM ol_dataset WHERE namespace_id NOT IN (SELECT namespace_id FROM ol_namespace WHERE regionkey <> 2)",
    lambda c: c.dataset.join(c.namespace.filter("regionkey <> 2").select("namespace_id"), "namespace_id", "left_anti").select("dataset_id"),
)
_integrity(
    "dup_ids",
    " SELECT substr(provenance_id, 1, 4) AS short_id, count(*) AS n FROM ol_column_provenance GROUP BY 1 HAVING count(*) > 1",
    lambda c: serve.repeated(c.edges.select(F.substring("provenance_id", 1, 4).alias("short_id")), ["short_id"]),
)
_integrity("active_flags", " SELECT is_active, count(*) AS n, is_active IN ('Y', 'N') AS valid FROM ol_column_provenance GROUP BY is_active", lambda c: c.edges.groupBy("is_active").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", F.col("is_active").isin("Y", "N")))
_integrity(
    "transformation_types",
    " SELECT transformation_type, count(*) AS n FROM ol_column_provenance WHERE transformation_type NOT IN ('DIRECT', 'CALCULATION') GROUP BY 1",
    lambda c: c.edges.filter(~F.col("transformation_type").isin("DIRECT", "CALCULATION")).groupBy("transformation_type").agg(F.count(F.lit(1)).alias("n")),
)
