"""Exports of the graph as lines of text, which Spark's writers put into files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.scalars import database_of, table_of

# The headers of the exported table.
HEADERS = ("Source Column", "Source Table", "Source Database", "Target Column", "Target Table", "Target Database", "Transformation Type", "Depth", "Confidence")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part (nodes or edges), json: one object for each node and each edge. ``nodes``: node, name, field_name, field_type, nullable;
    ``edges``: id, ends, type and confidence. Null values have no key. Lines, not one document, so that no task holds the graph."""
    n = F.struct(
        F.col("node").alias("id"), F.lit("column").alias("type"), database_of(F.col("name")).alias("databaseName"), table_of(F.col("name")).alias("tableName"), F.col("field_name").alias("columnName"),
        F.struct(F.col("field_type").alias("columnType"), "nullable").alias("metadata"),
    )
    e = F.struct(F.col("provenance_id").alias("id"), F.col("src").alias("source"), F.col("tgt").alias("target"), F.col("transformation_type").alias("transformationType"), F.col("confidence_score").alias("confidenceScore"))
    return nodes.select(F.lit("nodes").alias("part"), F.to_json(n).alias("json")).unionByName(edges.select(F.lit("edges").alias("part"), F.to_json(e).alias("json")))


def edges_csv(edges: DataFrame) -> DataFrame:
    """line: the header, and each edge as comma-separated values, quoted where they need it; a confidence as whole percents, a missing
    one empty. An edge without depth is a direct one, of depth 1."""
    percent = F.when(F.col("confidence_score") > 1, F.col("confidence_score")).otherwise(F.col("confidence_score") * 100)
    depth = F.col("depth") if "depth" in edges.columns else F.lit(1)
    ends = [x for side in ("source", "target") for x in (F.col(f"{side}_field"), table_of(F.col(f"{side}_dataset")), database_of(F.col(f"{side}_dataset")))]
    row = F.struct(*[x.alias(f"c{k}") for k, x in enumerate([*ends, F.col("transformation_type"), depth, F.concat(F.round(percent).cast("int").cast("string"), F.lit("%"))])])
    header = edges.sparkSession.createDataFrame([(",".join(HEADERS),)], "line string")
    return header.unionByName(edges.select(F.to_csv(row).alias("line")))
