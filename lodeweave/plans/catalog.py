"""Catalog ingest and serving queries: namespaces, datasets, fields, statistics, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions.scalars import as_boolean, database_of, is_latin, match_score, table_of
from lodeweave.operators import serve
from lodeweave.plans.base import Registry
from lodeweave.sources.catalog_views import Frames

R = Registry()
query, QUERIES, ORACLES = R.query, R.queries, R.oracles

ASIA = "warehouse://asia:1025"
_ASIA_ID = f"substr(md5('{ASIA}'), 1, 16)"
_ISO_SQL = "strftime(created_at, '%Y-%m-%dT%H:%M:%S')"


def _asia():
    return F.substring(F.md5(F.lit(ASIA)), 1, 16)


def _first(datasets):
    """The dataset of least name."""
    return datasets.orderBy("name").limit(1)


_FIRST = "(SELECT * FROM ol_dataset ORDER BY name LIMIT 1)"


# ---- ingest


@query(
    """ SELECT namespace_id, namespace_uri, CASE WHEN regionkey < 2 THEN 'known' ELSE 'new' END AS state FROM ol_namespace""",
)
def catalog_namespaces(spark, d):
    """Namespaces after an ingest that adds the unknown ones."""
    ns = Frames(spark, d).namespace
    known = ns.filter("regionkey < 2")
    both = serve.add_missing(known.withColumn("state", F.lit("known")), ns.withColumn("state", F.lit("new")), ["namespace_id"])
    return both.select("namespace_id", "namespace_uri", "state")


_DICTIONARY = """, dict_table AS (
  SELECT dataset_id, name, suppkey, CASE suppkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'V' WHEN 2 THEN 'O' ELSE 'M' END AS kind,
         CASE WHEN suppkey % 11 = 0 THEN 'OL_T' || suppkey WHEN suppkey % 13 = 0 THEN 'OLD_T' || suppkey ELSE 'T' || suppkey END AS table_name FROM ol_dataset)"""


def _dictionary(c: Frames):
    k = F.col("suppkey")
    kind = F.when(k % 4 == 0, "T").when(k % 4 == 1, "V").when(k % 4 == 2, "O").otherwise("M")
    name = F.when(k % 11 == 0, F.concat(F.lit("OL_T"), k.cast("string"))).when(k % 13 == 0, F.concat(F.lit("OLD_T"), k.cast("string"))).otherwise(F.concat(F.lit("T"), k.cast("string")))
    return c.dataset.select("dataset_id", "name", "suppkey", kind.alias("kind"), name.alias("table_name"))


@query(_DICTIONARY + """ SELECT dataset_id, table_name, CASE WHEN kind = 'V' THEN 'VIEW' ELSE 'TABLE' END AS source_type FROM dict_table
WHERE kind IN ('T', 'V', 'O') AND NOT regexp_matches(table_name, '^(LIN|OL)_') AND suppkey % 5 <> 0""")
def catalog_datasets(spark, d):
    """Tables and views of the dictionary that the catalog lacks; the catalog's own tables (OL_, LIN_) stay out, OLD_ stays in."""
    c = Frames(spark, d)
    found = _dictionary(c).filter(F.col("kind").isin("T", "V", "O") & ~serve.own_table(F.col("table_name")) & is_latin(F.col("table_name")))
    known = c.dataset.filter(F.col("suppkey") % 5 == 0).select("dataset_id")
    return found.join(known, "dataset_id", "left_anti").select("dataset_id", "table_name", F.when(F.col("kind") == "V", "VIEW").otherwise("TABLE").alias("source_type"))


@query(_DICTIONARY + """ SELECT f.field_id, f.field_type, f.ordinal_position FROM ol_dataset_field f WHERE f.dataset_id IN (SELECT dataset_id FROM dict_table WHERE kind IN ('T', 'V', 'O'))
AND f.ordinal_position % 3 <> 0""")
def catalog_fields(spark, d):
    c = Frames(spark, d)
    field = c.fields_of(_dictionary(c).filter(F.col("kind").isin("T", "V", "O"))).select("field_id", "field_type", "ordinal_position")
    known, parts = field.filter(F.col("ordinal_position") % 3 == 0).select("field_id"), c.parts
    field, known = field.repartition(parts, "field_id"), known.repartition(parts, "field_id")
    return field.join(known, "field_id", "left_anti").select("field_id", "field_type", "ordinal_position")


@query(""" SELECT 'OL_NAMESPACE' AS table_name, count(*) AS row_count FROM ol_namespace UNION ALL SELECT 'OL_DATASET', count(*) FROM ol_dataset
UNION ALL SELECT 'OL_DATASET_FIELD', count(*) FROM ol_dataset_field UNION ALL SELECT 'OL_COLUMN_PROVENANCE', count(*) FROM ol_column_provenance""")
def catalog_counts(spark, d):
    c = Frames(spark, d)
    return serve.row_counts({"OL_NAMESPACE": c.namespace, "OL_DATASET": c.dataset, "OL_DATASET_FIELD": c.field, "OL_COLUMN_PROVENANCE": c.edges})


# ---- serving

_NS = f"SELECT namespace_id, namespace_uri AS uri, coalesce(trim(description), '') AS description, coalesce(spec_version, '2-0-2') AS spec_version, {_ISO_SQL} AS created_at FROM ol_namespace"


@query(f" {_NS}")
def list_namespaces(spark, d):
    return serve.namespaces(Frames(spark, d).namespace)


@query(f" {_NS} WHERE namespace_id = {_ASIA_ID}")
def get_namespace(spark, d):
    return serve.namespaces(Frames(spark, d).namespace.filter(F.col("namespace_id") == _asia()))


@query(" SELECT namespace_id, namespace_uri FROM ol_namespace ORDER BY created_at, namespace_id LIMIT 1")
def default_namespace(spark, d):
    return Frames(spark, d).namespace.orderBy("created_at", "namespace_id").limit(1).select("namespace_id", "namespace_uri")


@query(f""" SELECT dataset_id, name, coalesce(description, '') AS description, source_type, (SELECT count(*) FROM ol_dataset WHERE namespace_id = {_ASIA_ID}) AS total
FROM ol_dataset WHERE namespace_id = {_ASIA_ID} ORDER BY name, dataset_id LIMIT 20 OFFSET 5""")
def list_datasets_page(spark, d):
    c = Frames(spark, d)
    return serve.dataset_page(c.dataset.filter(F.col("namespace_id") == _asia()), limit=20, offset=5)


@query(f""" SELECT s.dataset_id, s.name, field_name, field_type, ordinal_position, CASE WHEN nullable IS NULL THEN true ELSE nullable = 'Y' END AS nullable
FROM {_FIRST} s JOIN ol_dataset_field f USING (dataset_id)""")
def get_dataset(spark, d):
    """A dataset with its fields."""
    c = Frames(spark, d)
    one = F.broadcast(_first(c.dataset).select("dataset_id", "name"))
    return c.field.join(one, "dataset_id").select("dataset_id", "name", "field_name", "field_type", "ordinal_position", as_boolean(F.col("nullable"), True).alias("nullable"))


@query(f""" SELECT dataset_id, split_part(name, '.', 1) AS database, split_part(name, '.', 2) AS "table" FROM ol_dataset
WHERE name = (SELECT name FROM {_FIRST}) OR dataset_id = (SELECT name FROM {_FIRST})""")
def resolve_dataset(spark, d):
    """A dataset by its id or by its name."""
    c = Frames(spark, d)
    wanted = _first(c.dataset).first()["name"]
    found = serve.resolve(c.dataset, wanted)
    return found.select("dataset_id", database_of(F.col("name")).alias("database"), table_of(F.col("name")).alias("table"))


@query(" SELECT dataset_id, name FROM ol_dataset WHERE starts_with(name, (SELECT split_part(name, '.', 1) || '.' FROM ol_dataset GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))")
def database_datasets(spark, d):
    """Datasets of the database that has the most."""
    datasets, db = Frames(spark, d).dataset, database_of(F.col("name"))
    largest = datasets.groupBy(db.alias("db")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "db").first()["db"]
    return datasets.filter(F.col("name").startswith(f"{largest}.")).select("dataset_id", "name")


@query(""", n AS (SELECT suppkey, l_linenumber, count(*) AS row_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS perm FROM lineitem JOIN ol_dataset ON suppkey = l_suppkey GROUP BY ALL)
SELECT name, source_type, max(row_count) AS row_count, CASE WHEN source_type = 'TABLE' THEN CAST(sum(perm) AS BIGINT) END AS size_bytes FROM ol_dataset JOIN n USING (suppkey) GROUP BY name, source_type""")
def dataset_statistics(spark, d):
    """The greatest recorded row count of each dataset, and the size of tables."""
    c = Frames(spark, d)
    stats = c.table("lineitem").groupBy(F.col("l_suppkey").alias("suppkey"), "l_linenumber").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("l_quantity").cast("long")).alias("perm"))
    return serve.statistics(c.dataset.select("suppkey", "name", "source_type"), stats, "suppkey")


@query(f""", t AS (SELECT s.name, s.source_type, 'CREATE ' || s.source_type || ' ' || s.name || ' (' || string_agg(field_name || ' ' || field_type, ', ' ORDER BY ordinal_position) || ')' AS ddl
FROM ol_dataset s JOIN ol_dataset_field f USING (dataset_id) GROUP BY s.name, s.source_type)
SELECT name, ddl, source_type = 'VIEW' AND length(ddl) >= 12500 AS truncated FROM t""")
def dataset_ddl(spark, d):
    c = Frames(spark, d)
    return serve.ddl(c.dataset, c.field)


@query(""" SELECT s.name, count(*) AS commented, string_agg(field_name || '=' || nullable, ',' ORDER BY field_name) AS comments
FROM ol_dataset s JOIN ol_dataset_field f USING (dataset_id) WHERE nullable IS NOT NULL AND trim(nullable) <> '' GROUP BY s.name""")
def column_comments(spark, d):
    """The comments that columns have, as one map for each dataset."""
    c = Frames(spark, d)
    fields = c.field.withColumn("comment", F.col("nullable")).join(c.dataset.select("dataset_id", "name"), "dataset_id")
    out = serve.comments(fields)
    pairs = F.transform(F.array_sort(F.map_keys("comments")), lambda k: F.concat(k, F.lit("="), F.element_at("comments", k)))
    return out.select("name", F.size("comments").cast("long").alias("commented"), F.array_join(pairs, ",").alias("comments"))


# ---- search

_MATCH = "(contains(lower(name), 't1') OR contains(lower(coalesce(description, '')), 't1'))"


@query(f" SELECT dataset_id, name, source_type FROM ol_dataset WHERE {_MATCH} ORDER BY name, dataset_id LIMIT 50")
def search_datasets(spark, d):
    return serve.search(Frames(spark, d).dataset, "t1").orderBy("name", "dataset_id").limit(50).select("dataset_id", "name", "source_type")


@query(f" SELECT split_part(name, '.', 1) AS database, count(*) AS matches FROM ol_dataset WHERE {_MATCH} GROUP BY 1")
def unified_search_databases(spark, d):
    """Databases of all matches, not only of the first page."""
    found = serve.search(Frames(spark, d).dataset, "t1")
    return found.groupBy(database_of(F.col("name")).alias("database")).agg(F.count(F.lit(1)).alias("matches"))


_SCORE = "CASE WHEN lower({0}) = 'p1' THEN 1.0 WHEN starts_with(lower({0}), 'p1') THEN 0.8 WHEN contains(lower({0}), 'p1') THEN 0.5 ELSE 0.0 END"


@query(f""" SELECT 'column' AS asset_type, field_id AS asset_id, CAST({_SCORE.format('field_name')} AS DOUBLE) AS score FROM ol_dataset_field WHERE contains(lower(field_name), 'p1')""")
def search_assets_typed(spark, d):
    c = Frames(spark, d)
    return serve.assets(c.dataset, c.field).filter(F.col("asset_type") == "column").withColumn("score", match_score(F.col("label"), "p1")).filter("score > 0").select("asset_type", "asset_id", "score")


_ASSETS = f"""SELECT 'database' AS asset_type, split_part(name, '.', 1) AS asset_id, split_part(name, '.', 1) AS label FROM ol_dataset GROUP BY ALL
UNION ALL SELECT 'table', dataset_id, split_part(name, '.', 2) FROM ol_dataset UNION ALL SELECT 'column', field_id, field_name FROM ol_dataset_field"""


@query(f" SELECT asset_type, count(*) AS assets, count(*) FILTER (WHERE contains(lower(label), '1')) AS matches FROM ({_ASSETS}) GROUP BY asset_type")
def search_assets(spark, d):
    """Assets of each type, and those whose name has the query."""
    c = Frames(spark, d)
    return serve.assets(c.dataset, c.field).groupBy("asset_type").agg(F.count(F.lit(1)).alias("assets"), F.count_if(match_score(F.col("label"), "1") > 0).alias("matches"))


_G = _SCORE.replace("'p1'", "'p12'")


@query(f""", s AS (SELECT field_id, greatest({_G.format('field_name')}, 0.7 * {_G.format("split_part(d.name, '.', 2)")}, 0.9 * {_G.format("(d.name || '.' || field_name)")}) AS s
FROM ol_dataset_field f JOIN ol_dataset d USING (dataset_id)) SELECT field_id, CAST(round(s, 4) AS DOUBLE) AS score FROM s WHERE s > 0 ORDER BY s DESC, field_id LIMIT 10""")
def graph_search(spark, d):
    """The ten best columns for a query, by name, table and full name."""
    c = Frames(spark, d)
    n = c.field.join(c.dataset.select("dataset_id", "name"), "dataset_id")
    score = F.greatest(match_score(F.col("field_name"), "p12"), match_score(table_of(F.col("name")), "p12") * 0.7, match_score(F.concat_ws(".", "name", "field_name"), "p12") * 0.9)
    found = n.select("field_id", F.round(score, 4).alias("score")).filter("score > 0")
    return found.orderBy(F.desc("score"), "field_id").limit(10)


@query(""" SELECT split_part(name, '.', 1) AS database, count(*) AS tables, string_agg(split_part(name, '.', 2), ',' ORDER BY split_part(name, '.', 2)) AS names FROM ol_dataset GROUP BY 1""")
def asset_tree(spark, d):
    names = F.array_join(F.array_sort(F.collect_list(table_of(F.col("name")))), ",")
    return Frames(spark, d).dataset.groupBy(database_of(F.col("name")).alias("database")).agg(F.count(F.lit(1)).alias("tables"), names.alias("names"))
