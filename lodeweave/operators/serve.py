"""Serving operators of the catalog: listings, pages, search, statistics, ingest helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.scalars import database_of, table_of

DDL_LIMIT = 12_500  # texts of views are cut by the dictionary at this length
MIN_QUERY = 2


def checked_query(text: str) -> str:
    """A search text of at least MIN_QUERY characters, trimmed; shorter ones raise ValueError."""
    text = (text or "").strip()
    if len(text) < MIN_QUERY:
        raise ValueError(f"a query needs at least {MIN_QUERY} characters")
    return text


def accepted_query(text: Column) -> Column:
    """Whether a text has MIN_QUERY characters at least when trimmed; null has not."""
    return F.coalesce(F.length(F.trim(text)) >= MIN_QUERY, F.lit(False))


def add_missing(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` with the rows of ``new`` whose keys it lacks; of rows of ``new`` with one key, one."""
    return known.unionByName(new.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti"))


def upsert(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, and those of ``known`` whose keys it lacks. Keys are distinct in each; null keys are equal to none."""
    return known.join(new.select(*keys), keys, "left_anti").unionByName(new)


def own_table(name: Column, *, compat: bool = False) -> Column:
    """The catalog's own tables, OL_ and LIN_. ``compat`` reads the underscore as any character, so OLD_X and LINEITEM match."""
    return (name.like("OL_%") | name.like("LIN_%")) if compat else name.rlike("^(LIN|OL)_")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def namespaces(ns: DataFrame) -> DataFrame:
    return ns.select(
        "namespace_id", F.col("namespace_uri").alias("uri"), F.coalesce(F.trim("description"), F.lit("")).alias("description"),
        F.coalesce("spec_version", F.lit("2-0-2")).alias("spec_version"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def dataset_page(datasets: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page by name, with the number of all datasets. Sorting is a top-k: tasks keep offset + limit rows at most."""
    page = datasets.orderBy("name", "dataset_id").offset(offset).limit(limit)
    return page.select("dataset_id", "name", F.coalesce(F.trim("description"), F.lit("")).alias("description"), "source_type", datasets.agg(F.count(F.lit(1))).scalar().alias("total"))


def page_of(offset: int, limit: int, total: int) -> tuple[int, int, int]:
    """Number of the page (from 1), of pages, and the offset of the last page."""
    pages = max(1, -(-total // limit))
    return offset // limit + 1, pages, (pages - 1) * limit


def page_columns(offset: Column, limit: Column, total: Column, new_limit: Column) -> list[Column]:
    """page, pages and last_offset as ``page_of`` has them, and resized_offset: where a page of ``new_limit`` rows begins that holds the
    first row of this one."""
    offset, limit, total, new_limit = (c.cast("long") for c in (offset, limit, total, new_limit))
    down = lambda a, b: F.floor(a / b).cast("long")
    pages = F.greatest(F.lit(1).cast("long"), F.ceil(total / limit).cast("long"))
    return [(down(offset, limit) + 1).alias("page"), pages.alias("pages"), ((pages - 1) * limit).alias("last_offset"), (down(offset, new_limit) * new_limit).alias("resized_offset")]


def resolve(datasets: DataFrame, wanted: str) -> DataFrame:
    return datasets.filter((F.col("dataset_id") == wanted) | (F.col("name") == wanted))


def statistics(datasets: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """name, source_type, row_count (the greatest recorded), size_bytes (tables only). ``stats``: key, row_count, perm."""
    per = stats.groupBy(key).agg(F.max("row_count").alias("row_count"), F.sum("perm").alias("size"))
    return datasets.join(per, key).select("name", "source_type", "row_count", F.when(F.col("source_type") == "TABLE", F.col("size")).alias("size_bytes"))


def ddl(datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """name, ddl and truncated: the statement that would create each dataset, from its fields."""
    cols = F.array_sort(F.collect_list(F.struct("ordinal_position", "field_name", "field_type")))
    per = fields.groupBy("dataset_id").agg(F.array_join(F.transform(cols, lambda x: F.concat_ws(" ", x["field_name"], x["field_type"])), ", ").alias("cols"))
    text = F.concat(F.lit("CREATE "), F.col("source_type"), F.lit(" "), F.col("name"), F.lit(" ("), F.col("cols"), F.lit(")"))
    return datasets.join(per, "dataset_id").select("name", text.alias("ddl"), ((F.col("source_type") == "VIEW") & (F.length(text) >= DDL_LIMIT)).alias("truncated"))


def comments(fields: DataFrame) -> DataFrame:
    """name, comments: a map of column to comment, where there is one. ``fields``: name, field_name, comment."""
    have = fields.filter(F.col("comment").isNotNull() & (F.trim("comment") != ""))
    return have.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "comment"))).alias("comments"))


def search(datasets: DataFrame, text: str) -> DataFrame:
    """Datasets whose name or description has the text, in any case of letters."""
    q = checked_query(text).lower()
    return datasets.filter(F.lower("name").contains(q) | F.lower(F.coalesce("description", F.lit(""))).contains(q))


def assets(datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """asset_type (database, table, column), asset_id, label."""
    db = datasets.select(F.lit("database").alias("asset_type"), database_of(F.col("name")).alias("asset_id"), database_of(F.col("name")).alias("label")).distinct()
    tables = datasets.select(F.lit("table"), "dataset_id", table_of(F.col("name")))
    return db.union(tables).union(fields.select(F.lit("column"), "field_id", "field_name"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
