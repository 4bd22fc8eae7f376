"""Queries over the upkeep of a catalog: constraints, indexed search, the merging sink, stored watermarks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave import api
from lodeweave.functions.scalars import database_of, match_score, table_of
from lodeweave.operators import constraints, extract, graph, trigrams
from lodeweave.plans.base import Registry
from lodeweave.plans.extraction import _EDGES, _OK, SINCE
from lodeweave.plans.graph import _TOP, _largest
from lodeweave.sources.catalog_views import Frames
from lodeweave.sources.scratch import shared_folder
from lodeweave.streaming import log_stream, merge_sink

R = Registry()
query, QUERIES, ORACLES = R.query, R.queries, R.oracles


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- constraints

_EDGE_RULES = {
    "confidence of 0.95 at least": ("confidence_score >= 0.95", lambda: F.col("confidence_score") >= 0.95),
    "confidence from 0 to 1": ("confidence_score BETWEEN 0 AND 1", lambda: F.col("confidence_score").between(0, 1)),
    "active or not": ("is_active IN ('Y', 'N')", lambda: F.col("is_active").isin("Y", "N")),
    "known transformation": ("transformation_type IN ('DIRECT', 'CALCULATION')", lambda: F.col("transformation_type").isin("DIRECT", "CALCULATION")),
    "no edge to itself": ("src <> tgt", lambda: F.col("src") != F.col("tgt")),
    "id of 24 characters": ("length(provenance_id) = 24", lambda: F.length("provenance_id") == 24),
}
_DATASET_RULES = {
    "no system database": ("split_part(name, '.', 1) NOT IN ('DBC', 'SYSLIB', 'SystemFe')", lambda db: constraints.outside(F.col("name"))),
    "not in the largest database": ("split_part(name, '.', 1) NOT IN (SELECT db FROM top1)", lambda db: constraints.outside(F.col("name"), db)),
    "described": ("description IS NOT NULL", lambda db: F.col("description").isNotNull()),
    "table or view": ("source_type IN ('TABLE', 'VIEW')", lambda db: F.col("source_type").isin("TABLE", "VIEW")),
}
_FIELD_RULES = {
    "type is known": ("field_type <> 'UNKNOWN'", lambda: F.col("field_type") != "UNKNOWN"),
    "null or not": ("nullable IN ('Y', 'N')", lambda: F.col("nullable").isin("Y", "N")),
    "position from 1": ("ordinal_position >= 1", lambda: F.col("ordinal_position") >= 1),
}


def _rules_sql(table: str, rules: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS checked, count(*) FILTER (NOT coalesce({sql}, false)) AS violated FROM {table}" for name, (sql, _) in rules.items())


_REFS = """, known AS (SELECT s.name || '.' || field_name AS node FROM ol_dataset s JOIN ol_dataset_field USING (dataset_id) WHERE ordinal_position % 10 <> 0)"""
_PRESENT = {"OL_NAMESPACE": 5, "OL_DATASET": 5, "OL_DATASET_FIELD": 5, "OL_COLUMN_PROVENANCE": 8, "OL_JOB": 5, "OL_RUN": 4, "OL_RUN_INPUT": 2, "OL_RUN_OUTPUT": 2, "OL_SCHEMA_VERSION": 3}


@query(
    _TOP
    + _REFS
    + f""" {_rules_sql("ol_column_provenance", _EDGE_RULES)} UNION ALL {_rules_sql("ol_dataset", _DATASET_RULES)} UNION ALL {_rules_sql("ol_dataset_field", _FIELD_RULES)}
UNION ALL SELECT 'source is registered', count(*), count(*) FILTER (src NOT IN (SELECT node FROM known)) FROM ol_column_provenance UNION ALL SELECT 'target is registered', count(*), count(*) FILTER (tgt NOT IN (SELECT node FROM known)) FROM ol_column_provenance
UNION ALL SELECT 'dataset is registered', count(*), count(*) FILTER (dataset_id NOT IN (SELECT dataset_id FROM ol_dataset WHERE suppkey % 6 <> 0)) FROM ol_dataset_field
UNION ALL SELECT 'columns of ' || t, n, CASE WHEN t LIKE 'OL_RUN%' OR t IN ('OL_JOB', 'OL_SCHEMA_VERSION') THEN n ELSE 0 END FROM (VALUES {", ".join(f"('{t}', {n})" for t, n in _PRESENT.items())}) v(t, n)"""
)
def constraint_report(spark, d):
    """One row for each rule: how many rows it was checked on and how many break it. Edges, datasets and fields are read once for their
    domains and once for their references; this catalog has no tables of jobs, runs and versions."""
    c, largest = Frames(spark, d), _largest(spark, d)
    known = graph.catalog_nodes(c.dataset, c.field.filter("ordinal_position % 10 <> 0"))
    tables = {"OL_NAMESPACE": c.namespace, "OL_DATASET": c.dataset, "OL_DATASET_FIELD": c.field, "OL_COLUMN_PROVENANCE": c.edges}
    parts = [
        constraints.domain_report(c.edges, {k: f() for k, (_, f) in _EDGE_RULES.items()}),
        constraints.domain_report(c.dataset, {k: f(largest) for k, (_, f) in _DATASET_RULES.items()}),
        constraints.domain_report(c.field, {k: f() for k, (_, f) in _FIELD_RULES.items()}),
        constraints.reference_report(c.edges, {"source is registered": F.col("src"), "target is registered": F.col("tgt")}, known, "node"),
        constraints.reference_report(c.field, {"dataset is registered": F.col("dataset_id")}, c.dataset.filter("suppkey % 6 <> 0"), "dataset_id"),
        constraints.presence_report(spark, tables),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- indexed search


@query(" SELECT dataset_id, name, source_type FROM ol_dataset WHERE contains(lower(name), 'on_1') OR contains(lower(coalesce(description, '')), 'on_1')")
def search_datasets_indexed(spark, d):
    """All datasets with the text in name or description, by an index of trigrams."""
    t, folder = Frames(spark, d).dataset, _scratch(spark, "trigrams")
    trigrams.build(t, "dataset_id", ["name", "description"], folder)
    return trigrams.search(t, "dataset_id", ["name", "description"], folder, "oN_1").select("dataset_id", "name", "source_type")


_SCORE = "CASE WHEN lower({0}) = 'p12' THEN 1.0 WHEN starts_with(lower({0}), 'p12') THEN 0.8 WHEN contains(lower({0}), 'p12') THEN 0.5 ELSE 0.0 END"


@query(f""" SELECT field_id, CAST(round(greatest({_SCORE.format('field_name')}, 0.7 * {_SCORE.format("split_part(d.name, '.', 2)")}, 0.9 * {_SCORE.format("(d.name || '.' || field_name)")}), 4) AS DOUBLE) AS score
FROM ol_dataset_field f JOIN ol_dataset d USING (dataset_id) WHERE contains(lower(d.name || '.' || field_name), 'p12')""")
def graph_search_indexed(spark, d):
    """Every column whose full name has the text, with its score; the best ten of them are those of graph_search."""
    c, folder = Frames(spark, d), _scratch(spark, "trigrams")
    n = c.field.join(c.dataset.select("dataset_id", "name"), "dataset_id").select("field_id", "field_name", "name", F.concat_ws(".", "name", "field_name").alias("full_name"))
    trigrams.build_parts({"name": c.dataset.select("name"), "field_name": c.column_names}, folder)
    found = trigrams.search_parts(n, ["name", "field_name"], folder, "p12")
    score = F.greatest(match_score(F.col("field_name"), "p12"), match_score(table_of(F.col("name")), "p12") * 0.7, match_score(F.col("full_name"), "p12") * 0.9)
    return found.select("field_id", F.round(score, 4).alias("score"))


@query(" SELECT split_part(name, '.', 1) AS database, count(*) AS matches FROM ol_dataset WHERE contains(lower(name), 'n_1') OR contains(lower(coalesce(description, '')), 'n_1') GROUP BY 1")
def search_databases_indexed(spark, d):
    """Databases of all matches of an indexed search."""
    t, folder = Frames(spark, d).dataset, _scratch(spark, "trigrams")
    trigrams.build(t, "dataset_id", ["name", "description"], folder)
    found = trigrams.search(t, "dataset_id", ["name", "description"], folder, "n_1")
    return found.groupBy(database_of(F.col("name")).alias("database")).agg(F.count(F.lit(1)).alias("matches"))


# ---- merging sink, watermarks


@query(_EDGES + """, p AS (SELECT regexp_extract(src, '^(.*)\\.[^.]*$', 1) AS source_table, regexp_extract(tgt, '^(.*)\\.[^.]*$', 1) AS target_table, start_time, query_id FROM y)
SELECT substr(md5(source_table || '->' || target_table), 1, 16) AS provenance_id, source_table, target_table, min(start_time) AS first_seen, max(start_time) AS last_seen, count(DISTINCT query_id) AS query_count FROM p GROUP BY ALL""")
def stream_table_rollup(spark, d):
    """Table edges with when they were seen and in how many statements, merged batch by batch by a stream's sink."""
    root, log = _scratch(spark, "rollup"), log_stream.log_stream(spark, d)
    kind = log.schema["start_time"].dataType.simpleString()
    merge_sink.run_merged(log, f"{root}/edges", checkpoint=f"{root}/checkpoint")
    out = merge_sink.rollup(spark, f"{root}/edges")
    return out.withColumns({c: F.col(c).cast(kind) for c in ("first_seen", "last_seen")})


@query(_OK + f""", runs(step, since, until) AS (VALUES ('dry run', NULL, TIMESTAMP '{SINCE}'), ('first', NULL, TIMESTAMP '{SINCE}'), ('second', TIMESTAMP '{SINCE}', TIMESTAMP '9999-01-01 00:00:00'), ('again', TIMESTAMP '9999-01-01 00:00:00', NULL))
SELECT step, statement_type, count(query_id) AS statements, max(start_time) AS newest FROM runs JOIN elig ON (since IS NULL OR start_time > since) AND start_time <= until GROUP BY ALL""")
def log_incremental_runs(spark, d):
    """Statements that runs over one store of watermarks read: a dry run, a run up to a day, a run over the whole log, and the same again,
    which finds nothing."""
    log, folder = extract.eligible(Frames(spark, d).log), _scratch(spark, "watermarks")
    early = log.filter(F.col("start_time") <= F.lit(SINCE).cast("timestamp"))
    steps = [("dry run", merge_sink.run_incremental(spark, folder, early, dry_run=True))]
    steps += [(name, merge_sink.run_incremental(spark, folder, part)) for name, part in (("first", early), ("second", log), ("again", log))]
    each = [part.groupBy("statement_type").agg(F.count(F.lit(1)).alias("statements"), F.max("start_time").alias("newest")).withColumn("step", F.lit(name)) for name, part in steps]
    return reduce(DataFrame.unionByName, each)


@query(_OK + " SELECT statement_type AS source_name, max(start_time) AS watermark FROM elig GROUP BY 1")
def log_watermarks_stored(spark, d):
    """The store of watermarks after two runs, as it is read back."""
    log, folder = extract.eligible(Frames(spark, d).log), _scratch(spark, "watermarks")
    merge_sink.run_incremental(spark, folder, log.filter(F.col("start_time") <= F.lit(SINCE).cast("timestamp")))
    merge_sink.run_incremental(spark, folder, log)
    kind = log.schema["start_time"].dataType.simpleString()
    return merge_sink.watermarks(spark, folder).select("source_name", F.col("watermark").cast(kind).alias("watermark"))


# ---- the facade


@query(_TOP + """, hit AS (SELECT * FROM ol_dataset WHERE contains(lower(name), 't1') OR contains(lower(coalesce(description, '')), 't1')), act AS (SELECT DISTINCT src, tgt FROM ol_column_provenance WHERE is_active = 'Y'),
root AS (SELECT src AS node FROM act GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), down(node, depth) AS (SELECT tgt, 1 FROM act WHERE src IN (SELECT node FROM root) UNION SELECT tgt, depth + 1 FROM down JOIN act ON src = node WHERE depth < 3)
SELECT 'namespaces' AS call, count(*) AS n FROM ol_namespace UNION ALL SELECT 'search', count(*) FROM (SELECT * FROM hit LIMIT 50) UNION ALL SELECT 'unified', count(*) + (SELECT count(DISTINCT split_part(name, '.', 1)) FROM hit) FROM (SELECT * FROM hit LIMIT 50)
UNION ALL SELECT 'downstream', count(DISTINCT node) FROM down WHERE node NOT IN (SELECT node FROM root) UNION ALL SELECT 'statement', 2""")
def facade_calls(spark, d):
    """How many rows the engine's calls give: listing, search, traversal from the busiest column, edges of one statement."""
    tables = Frames(spark, d)
    root = tables.edges.filter("is_active = 'Y'").groupBy("src").agg(F.count_distinct("tgt").alias("n")).orderBy(F.desc("n"), "src").first()["src"]
    calls = {
        "namespaces": api.Catalog(tables).namespaces(), "search": api.Search(tables).datasets("t1"), "unified": api.Search(tables).unified("t1"),
        "downstream": api.Provenance(tables).downstream(root, 3), "statement": api.statement_edges(spark, "INSERT INTO t (a, b) SELECT q.x, q.y FROM (SELECT x, y FROM u) q", "db"),
    }
    return reduce(DataFrame.unionByName, [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("call"), "n") for name, f in calls.items()])
