"""Column provenance of logged statements: clean texts, edges as rows, first of each, eligible statements.

The edges of a text come from ``scopes``, as DataFrame operations; no parser runs beside them. What has a target and tables
but no column edges gives table edges (* to *) with low confidence; what has neither is reported with its status, never raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import ids
from lodeweave.functions.scalars import transformation
from lodeweave.operators import scopes

STATEMENTS = ("Insert", "Merge Into", "Create Table", "Create View", "Update")


def plain_text(sql: Column) -> Column:
    """A statement without comments, its literals empty, white space as single spaces, no semicolon at the end.

    Literals, quoted names and comments are met in one pass, so an apostrophe in a comment opens no literal and two
    hyphens in a literal open no comment. FROM within the brackets of EXTRACT, TRIM and SUBSTRING, which names no table, goes.
    """
    text = F.regexp_replace(sql, r"""(?s)('(?:[^']|'')*+'|"[^"]*+")|/\*.*?\*/|--[^\n]*+""", " $1 ")
    text = F.regexp_replace(text, r"'(?:[^']|'')*+'", "''")
    text = F.regexp_replace(F.regexp_replace(text, r'\s*\.\s*(")|(")\s*\.\s*', "$2.$1"), r"\s+", " ")
    text = F.regexp_replace(text, r"(?i)\bEXTRACT\s*\(\s*\w+\s+FROM\s+", "EXTRACT(")
    text = F.regexp_replace(text, r"(?i)\bTRIM\s*\(\s*(?:BOTH|LEADING|TRAILING)\b", "TRIM(")
    text = F.regexp_replace(text, r"(?i)\b(TRIM|SUBSTRING)\s*\((?!\s*SEL)([^()]*?)\s*\bFROM\s+", "$1($2 || ")
    return F.regexp_replace(F.trim(text), r"[; ]+$", "")


def extract_log(log: DataFrame, *, text_col: str = "sql_text", database_col: str = "default_database", fields: DataFrame | None = None) -> DataFrame:
    """``log`` with target (database.table), edges, conditions, n_unresolved, sources (tables, for the fallback) and status added.

    status: ok (column edges), fallback (tables only), failed (no target or no tables), skipped (no text). A null text is skipped.
    conditions are the columns that ON, WHERE and MERGE conditions read. Unresolved columns have no edge and are counted in n_unresolved. ``fields``:
    the catalog's columns (name, field_name, ordinal_position), or its tables with their lists (name, cols), for stars and for columns without qualifier. Logs repeat their
    statements: each distinct text of a database is read once and joined back by its digest.
    """
    keyed = _keyed(log, text_col, database_col)
    out = keyed.join(_read_once(keyed, text_col, database_col, fields), "_text", "left")
    none = out.schema["edges"].dataType.simpleString()
    lists = {c: F.coalesce(c, F.array().cast(none)) for c in ("edges", "conditions")}
    return out.withColumns(lists | {"n_unresolved": F.coalesce("n_unresolved", F.lit(0)), "status": _status()}).drop("_text")


def extract_earliest(log: DataFrame, *, text_col: str = "sql_text", database_col: str = "default_database", fields: DataFrame | None = None) -> DataFrame:
    """The rows of ``extract_log`` for the earliest statement (start_time, then query_id) of each distinct text: query_id, start_time, target,
    edges, conditions, n_unresolved, sources and status. Enough for the first statement of every edge: the log is only counted down to
    its distinct texts, and none of its rows is joined or repeated for each edge. Statements without text have no row."""
    keyed = _keyed(log, text_col, database_col).filter("_text is not null")
    earliest = keyed.groupBy("_text").agg(F.min(F.struct("start_time", "query_id")).alias("_first")).select("_text", "_first.*")
    return earliest.join(_read_once(keyed, text_col, database_col, fields), "_text").withColumn("status", _status()).drop("_text")


def _keyed(log: DataFrame, text_col: str, database_col: str) -> DataFrame:
    """``log`` with the digest of its text and database in _text, null for a null text."""
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col(database_col), F.lit("")), F.col(text_col)))
    return log.withColumn("_text", F.when(F.col(text_col).isNotNull(), key))


def _read_once(keyed: DataFrame, text_col: str, database_col: str, fields: DataFrame | None) -> DataFrame:
    """_text and what ``scopes`` finds in it, a row for each distinct text."""
    texts = keyed.filter("_text is not null").groupBy(F.col("_text").alias("key")).agg(F.first(text_col).alias("sql"), F.first(database_col).alias("db"))
    return scopes.provenance(texts, plain_text(F.col("sql")), fields).withColumnRenamed("key", "_text")


def _status() -> Column:
    return F.when(F.col("_text").isNull(), "skipped").when(F.size("edges") > 0, "ok").when(F.col("target").isNotNull() & (F.size("sources") > 0), "fallback").otherwise("failed")


#: A log of unlike statements is read in the same way.
extract = extract_log


def expand_stars(edges: DataFrame, fields: DataFrame) -> DataFrame:
    """``edges`` (source, source_column, target, target_column) whose source_column is * as one edge for each column that the
    catalog has for the source; sources that it lacks keep the *. ``fields``: name (database.table), field_name."""
    known = fields.select(F.col("name").alias("source"), F.col("field_name").alias("_field"))
    star = edges.filter("source_column = '*'").join(known, "source", "left")
    named = star.withColumn("source_column", F.coalesce("_field", "source_column")).withColumn("target_column", F.when(F.col("target_column") == "*", F.coalesce("_field", F.lit("*"))).otherwise(F.col("target_column")))
    return edges.filter("source_column <> '*'").unionByName(named.drop("_field").select(*edges.columns))


def edge_rows(extracted: DataFrame) -> DataFrame:
    """One row for each edge: source and target columns, kind, type, subtype, confidence and provenance_id."""
    keep = ["query_id", "start_time", "target"]
    cols = extracted.filter("status = 'ok'").select(*keep, F.explode("edges").alias("e")).select(*keep, F.col("e.source").alias("source"), "e.source_column", "e.target_column", "e.kind")
    whole = extracted.filter("status = 'fallback'").select(*keep, F.explode("sources").alias("source"), F.lit("*").alias("source_column"), F.lit("*").alias("target_column"), F.lit("UNKNOWN").alias("kind"))
    out = cols.unionByName(whole)
    kind, sub, conf = transformation(F.col("kind"))
    s, t = ids.node_id(F.col("source"), F.col("source_column")), ids.node_id(F.col("target"), F.col("target_column"))
    return out.select(ids.provenance_id(s, t).alias("provenance_id"), s.alias("src"), t.alias("tgt"), "kind", kind.alias("transformation_type"), sub.alias("transformation_subtype"), conf.alias("confidence_score"), "query_id", "start_time")


def condition_rows(extracted: DataFrame) -> DataFrame:
    """One row for each column that a condition reads, as an indirect edge to all of the target (*): the columns of ``edge_rows``."""
    e = extracted.select("query_id", "start_time", "target", F.explode("conditions").alias("e"))
    kind, sub, conf = transformation(F.col("e.kind"))
    s, t = ids.node_id(F.col("e.source"), F.col("e.source_column")), ids.node_id(F.col("target"), F.col("e.target_column"))
    return e.select(ids.provenance_id(s, t).alias("provenance_id"), s.alias("src"), t.alias("tgt"), F.col("e.kind").alias("kind"), kind.alias("transformation_type"), sub.alias("transformation_subtype"), conf.alias("confidence_score"), "query_id", "start_time")


def first_of_each(edges: DataFrame) -> DataFrame:
    """One row for each provenance_id, of the earliest statement: partial aggregates, no sort of a key's rows."""
    rest = [c for c in edges.columns if c != "provenance_id"]
    return edges.groupBy("provenance_id").agg(F.min_by(F.struct(*rest), F.struct("start_time", "query_id", "kind")).alias("r")).select("provenance_id", "r.*")


def joined_texts(headers: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """``headers`` with segments (their number) and sql_text: the pieces of ``segments`` (keys, row_no, piece) in order. A text is put
    together before the join, so a header meets one row; headers without segments fall out."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "piece"))), lambda x: x["piece"]), "")
    texts = segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), whole.alias("sql_text"))
    return headers.join(texts, keys)


def eligible(log: DataFrame, since: str | None = None, statements: tuple[str, ...] = STATEMENTS) -> DataFrame:
    """Statements to read: of the given types, without error, first text segment, after ``since``."""
    out = log.filter(F.col("statement_type").isin(*statements) & (F.col("error_code") == 0) & (F.col("sql_row_no") == 1))
    return out if since is None else out.filter(F.col("start_time") > F.lit(since).cast("timestamp"))
