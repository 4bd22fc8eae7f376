"""Queries of the scalar functions over sample rows, and the fixture of source-to-report mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import ids
from lodeweave.functions import scalars as S
from lodeweave.operators import serve
from lodeweave.plans.base import Registry
from lodeweave.sources import fixtures
from lodeweave.sources.catalog_views import Frames

R = Registry()
query, QUERIES, ORACLES = R.query, R.queries, R.oracles


@query(
    """SELECT o_orderkey, substr(md5('db.t' || o_orderkey || '.a->db.t' || o_custkey || '.b'), 1, 24) AS provenance_id, substr(md5('db.t' || o_orderkey || '.a->db.t' || o_custkey || '.b'), 1, 16) AS legacy_id,
'ns/db.t' || o_orderkey AS dataset_id, 'ns/db.t' || o_orderkey || '/a' AS field_id, 'db.t' || o_orderkey || '.a' AS node_id, 'db.t' || o_orderkey || '.a->db.t' || o_custkey || '.b' AS edge_id FROM orders""",
    views=False,
)
def scalar_ids(spark, d):
    o = Frames(spark, d).table("orders")
    name = lambda c: F.concat(F.lit("db.t"), F.col(c).cast("string"))
    s, t = ids.node_id(name("o_orderkey"), F.lit("a")), ids.node_id(name("o_custkey"), F.lit("b"))
    ds = ids.dataset_id(F.lit("ns"), name("o_orderkey"))
    return o.select("o_orderkey", ids.provenance_id(s, t).alias("provenance_id"), ids.provenance_id(s, t, 16).alias("legacy_id"), ds.alias("dataset_id"), ids.field_id(ds, F.lit("a")).alias("field_id"), s.alias("node_id"), ids.edge_id(s, t).alias("edge_id"))


@query(
    """, n AS (SELECT name FROM ol_dataset UNION ALL SELECT replace(name, '.', '') FROM ol_dataset) SELECT name, split_part(name, '.', 1) AS database, CASE WHEN contains(name, '.') THEN split_part(name, '.', 2) ELSE name END AS table_name FROM n""",
)
def scalar_split_name(spark, d):
    ds = Frames(spark, d).dataset
    n = ds.select("name").union(ds.select(F.translate("name", ".", "")))
    return n.select("name", S.database_of(F.col("name")).alias("database"), S.table_of(F.col("name")).alias("table_name"))


@query(" SELECT field_type, count(*) AS fields FROM ol_dataset_field GROUP BY field_type")
def scalar_type_names(spark, d):
    return Frames(spark, d).field.groupBy("field_type").agg(F.count(F.lit(1)).alias("fields"))


_MAP = ", ".join(f"('{k}', '{a}', '{b}', {c})" for k, (a, b, c) in S.TRANSFORMATIONS.items())


@query(
    f"""SELECT kind, coalesce(m.t, 'DIRECT') AS type, coalesce(m.s, 'TRANSFORMATION') AS subtype, CAST(coalesce(m.c, 0.60) AS DECIMAL(3, 2)) AS confidence, n
FROM (SELECT upper(l_shipmode) AS kind, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'DIRECT', 1 UNION ALL SELECT 'CALCULATION', 1 UNION ALL SELECT 'AGGREGATION', 1 UNION ALL SELECT 'JOIN', 1 UNION ALL SELECT 'FILTER', 1)
LEFT JOIN (VALUES {_MAP}) m(k, t, s, c) ON m.k = kind""".replace("upper(l_shipmode)", "'X' || l_returnflag"),
    views=False,
)
def scalar_transformation_map(spark, d):
    seen = Frames(spark, d).table("lineitem").groupBy(F.concat(F.lit("X"), "l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(k, 1) for k in S.TRANSFORMATIONS], "kind string, n long")
    t, s, c = S.transformation(F.col("kind"))
    return seen.union(known).select("kind", t.alias("type"), s.alias("subtype"), c.alias("confidence"), "n")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'view' WHEN p_size % 5 = 1 THEN 'materialized_view' ELSE 'table' END AS asset_type FROM part""",
    views=False,
)
def scalar_asset_type(spark, d):
    k = F.get(F.array(F.lit(" View"), F.lit("m"), F.lit("T"), F.lit("other"), F.lit(None).cast("string")), F.col("p_size") % 5)
    return Frames(spark, d).table("part").select("p_partkey", S.asset_type(k).alias("asset_type"))


_B = "CAST(l_orderkey AS BIGINT) * l_orderkey * l_linenumber"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b >= 1099511627776 THEN ((b * 100 + 549755813888) // 1099511627776) // 100 || '.' || lpad(CAST(((b * 100 + 549755813888) // 1099511627776) % 100 AS VARCHAR), 2, '0') || ' TB' WHEN b >= 1073741824 THEN ((b * 100 + 536870912) // 1073741824) // 100 || '.' || lpad(CAST(((b * 100 + 536870912) // 1073741824) % 100 AS VARCHAR), 2, '0') || ' GB'
WHEN b >= 1048576 THEN ((b * 100 + 524288) // 1048576) // 100 || '.' || lpad(CAST(((b * 100 + 524288) // 1048576) % 100 AS VARCHAR), 2, '0') || ' MB' WHEN b >= 1024 THEN ((b * 100 + 512) // 1024) // 100 || '.' || lpad(CAST(((b * 100 + 512) // 1024) % 100 AS VARCHAR), 2, '0') || ' KB' WHEN b <= 0 THEN '0 B' ELSE b || ' B' END AS size FROM (SELECT *, {_B} AS b FROM lineitem)""",
    views=False,
)
def scalar_format_bytes(spark, d):
    b = F.col("l_orderkey").cast("long") * F.col("l_orderkey") * F.col("l_linenumber")
    return Frames(spark, d).table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.format_bytes(b).alias("size"))


@query(
    """SELECT l_partkey AS k, CASE WHEN s < 60 THEN CAST(floor(s) AS BIGINT) || 's' ELSE CAST(floor(s) AS BIGINT) // 60 || 'm ' || CAST(floor(s) AS BIGINT) % 60 || 's' END AS duration,
CASE WHEN pr >= 10 THEN round(s / (pr / 100.0) - s, 2) END AS seconds_left FROM (SELECT DISTINCT l_partkey, (l_partkey % 500) / 4.0 AS s, l_partkey % 101 AS pr FROM lineitem)""",
    views=False,
)
def scalar_format_duration(spark, d):
    k = Frames(spark, d).table("lineitem").select(F.col("l_partkey").alias("k")).distinct()
    s, p = (F.col("k") % 500) / F.lit(4.0), F.col("k") % 101
    return k.select("k", S.format_duration(s).alias("duration"), S.time_left(s, p).alias("seconds_left"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size <= 20 THEN 1.0 WHEN p_size >= 50 THEN 0.5 ELSE round(1.0 - (p_size - 20) / 30.0 * 0.5, 4) END AS DOUBLE) AS zoom FROM part", views=False)
def scalar_zoom(spark, d):
    return Frames(spark, d).table("part").select("p_partkey", S.zoom(F.col("p_size")).alias("zoom"))


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\x{00}-\\x{FF}]') AS latin FROM documents", views=False)
def scalar_latin_check(spark, d):
    return Frames(spark, d).table("documents").select("doc_id", S.is_latin(F.col("text")).alias("latin"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3723 SECOND ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS parsed FROM orders""",
    views=False,
)
def scalar_parse_datetime(spark, d):
    """The three accepted forms; others are null."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    text = F.when(k == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 01:02:03"))).when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.date_format(day, "yyyyMMdd")).otherwise(F.lit("yesterday"))
    return Frames(spark, d).table("orders").select("o_orderkey", S.parse_datetime(text).alias("parsed"))


@query("SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '[; ]+$', '')) AS cleaned FROM documents", views=False)
def scalar_clean_sql(spark, d):
    return Frames(spark, d).table("documents").select("doc_id", S.clean_sql(F.col("text")).alias("cleaned"))


def _mappings(spark, d):
    return fixtures.mappings(Frames(spark, d).table("nation").select(F.col("n_name").alias("database")))


@query(fixtures.MAPPING_SQL, views=False)
def fixture_provenance(spark, d):
    """The source-to-report mappings of each database, with their paths and ids."""
    return _mappings(spark, d)


@query(f"SELECT transformation_type, split_part(source_path, '.', 2) AS source_table, count(*) AS edges FROM ({fixtures.MAPPING_SQL}) GROUP BY ALL", views=False)
def fixture_breakdown(spark, d):
    return _mappings(spark, d).groupBy("transformation_type", F.split("source_path", r"\.")[1].alias("source_table")).agg(F.count(F.lit(1)).alias("edges"))


_BUCKETS = "CASE WHEN split_part(source_dataset, '.', 1) = split_part(target_dataset, '.', 1) THEN 'one database' WHEN source_field = target_field THEN 'same field' WHEN transformation_type LIKE 'AGG%' THEN 'aggregates' WHEN source_dataset LIKE '%1' THEN 'from a first table' ELSE 'other' END"


@query(f" SELECT {_BUCKETS} AS bucket, count(*) AS edges FROM ol_column_provenance GROUP BY 1 ORDER BY 1")
def edge_buckets(spark, d):
    """Edges by the first of several conditions that they meet."""
    e, db = Frames(spark, d).edges, lambda c: F.substring_index(c, ".", 1)
    bucket = F.when(db("source_dataset") == db("target_dataset"), "one database").when(F.col("source_field") == F.col("target_field"), "same field").when(F.col("transformation_type").like("AGG%"), "aggregates")
    bucket = bucket.when(F.col("source_dataset").like("%1"), "from a first table").otherwise("other")
    return e.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("edges")).orderBy("bucket")


@query(" SELECT provenance_id, split_part(src, '.', 1) AS source_database, split_part(src, '.', 2) AS source_table, split_part(src, '.', 3) AS source_column, split_part(tgt, '.', 1) AS target_database, split_part(tgt, '.', 2) AS target_table, split_part(tgt, '.', 3) AS target_column FROM ol_column_provenance")
def path_parts(spark, d):
    """The paths of every edge, cut into database, table and column."""
    part = lambda c, k, name: F.split(c, r"\.")[k].alias(name)
    names = ("database", "table", "column")
    return Frames(spark, d).edges.select("provenance_id", *[part(c, k, f"{side}_{n}") for c, side in (("src", "source"), ("tgt", "target")) for k, n in enumerate(names)])


@query("SELECT n_nationkey, length(trim(substr('  ' || n_name, 1, CAST(n_nationkey % 5 AS INTEGER)))) >= 2 AS accepted FROM nation", views=False)
def scalar_query_accepted(spark, d):
    """Whether a text, with white space around it, is long enough to search for."""
    text = F.substr(F.concat(F.lit("  "), F.col("n_name")), F.lit(1), (F.col("n_nationkey") % 5).cast("int"))
    return Frames(spark, d).table("nation").select("n_nationkey", serve.accepted_query(text).alias("accepted"))


@query("""SELECT o_orderkey, CAST(o // l + 1 AS BIGINT) AS page, CAST(greatest(1, ceil(t / CAST(l AS DOUBLE))) AS BIGINT) AS pages, CAST((greatest(1, ceil(t / CAST(l AS DOUBLE))) - 1) * l AS BIGINT) AS last_offset, CAST(o // (l + 7) * (l + 7) AS BIGINT) AS resized_offset
FROM (SELECT o_orderkey, o_orderkey % 90 AS o, 5 + o_custkey % 20 AS l, o_custkey % 130 AS t FROM orders)""", views=False)
def scalar_page_arithmetic(spark, d):
    """Page, pages, offset of the last page, and the offset that keeps the first item when pages become larger."""
    o = Frames(spark, d).table("orders")
    page = serve.page_columns(F.col("o_orderkey") % 90, 5 + F.col("o_custkey") % 20, F.col("o_custkey") % 130, 12 + F.col("o_custkey") % 20)
    return o.select("o_orderkey", *page)
