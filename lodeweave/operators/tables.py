"""The provenance graph as tables: columns by table, edges with the names of their tables, filters, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGE_NODES = 200


def columns_of_tables(datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """name, columns: each table's columns by ordinal, then name."""
    cols = F.array_sort(F.collect_list(F.struct("ordinal_position", "field_name", "field_type")))
    return fields.groupBy("dataset_id").agg(cols.alias("columns")).join(datasets.select("dataset_id", "name"), "dataset_id").select("name", "columns")


def geometry(datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """name, width, height, large: the box of a table node, from its longest label and its number of columns."""
    per = fields.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("c"), F.max(F.length("field_name")).alias("longest"))
    t = per.join(datasets.select("dataset_id", "name"), "dataset_id")
    wide = F.least(F.greatest(F.lit(200), F.greatest(F.length("name"), F.col("longest")) * 8 + 60), F.lit(400))
    return t.select("name", wide.cast("int").alias("width"), (F.col("c") * 28 + 40).alias("height"), (F.col("c") >= LARGE_NODES).alias("large"))


def large_graph(nodes: DataFrame, depth: int) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    large = F.col("nodes") >= LARGE_NODES
    return n.select("nodes", large.alias("large"), F.when(large, max(3, depth - 2)).otherwise(depth).alias("suggested_depth"))


def edge_table(edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row for each edge with the registered names of both tables, which are those that it has itself. Filters on them are
    applied to the edges before they are joined."""
    out = edges.select("provenance_id", F.col("source_dataset").alias("source_table"), "source_field", F.col("target_dataset").alias("target_table"), "target_field", "transformation_type", "confidence_score")
    for c in ("source_table", "target_table"):
        out = out.join(datasets.select(F.col("name").alias(c)), c, "left")
    return out.select("provenance_id", "source_table", "source_field", "target_table", "target_field", "transformation_type", "confidence_score")


def matching(table: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any of the five names, in any case of letters; an empty text keeps all."""
    q, hit = text.lower(), F.lit(False)
    for c in ("source_table", "source_field", "target_table", "target_field", "transformation_type"):
        hit = hit | F.lower(c).contains(q)
    return table.filter(hit)


def ordered(table: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """By a chosen column, then by id; a missing confidence counts as -1."""
    k = F.coalesce(F.col(key), F.lit(-1)) if key == "confidence_score" else F.col(key)
    return table.orderBy(k.desc() if descending else k.asc(), "provenance_id")


def between_types(table: DataFrame, datasets: DataFrame, types: list[str]) -> DataFrame:
    keep = datasets.filter(F.col("source_type").isin(*types)).select("name")
    return table.join(keep.withColumnRenamed("name", "source_table"), "source_table", "left_semi").join(keep.withColumnRenamed("name", "target_table"), "target_table", "left_semi").select(*table.columns)
