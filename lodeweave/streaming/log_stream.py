"""Structured Streaming over the log of statements: extraction, deduplication, sink and throughput."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import ids
from lodeweave.operators import extract
from lodeweave.sources.catalog_views import Frames, log_of
from lodeweave.sources.scratch import shared_folder

LATE = "30 days"


def log_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 64) -> DataFrame:
    """The log as a stream over the event files."""
    schema = Frames(spark, sf_dir).table("events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events*.parquet")
    return log_of(events)


def throughput(log: DataFrame, size: str = "1 hour") -> DataFrame:
    """Statements by event-time window; a window is closed, and its state dropped, LATE after it (append and update mode)."""
    kind = log.schema["start_time"].dataType.simpleString()
    w = extract.eligible(log).withColumn("start_time", F.col("start_time").cast("timestamp")).withWatermark("start_time", LATE).groupBy(F.window("start_time", size))
    return w.agg(F.count(F.lit(1)).alias("statements")).select(F.col("window.start").cast(kind).alias("hour"), "statements")


def table_rollup(edges: DataFrame) -> DataFrame:
    """Table edges with first and last time and the number of statements."""
    t = edges.select(F.regexp_extract("src", r"^(.*)\.[^.]*$", 1).alias("source_table"), F.regexp_extract("tgt", r"^(.*)\.[^.]*$", 1).alias("target_table"), "start_time", "query_id")
    one = t.groupBy("source_table", "target_table").agg(F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"), F.count_distinct("query_id").alias("query_count"))
    return one.select(ids.provenance_id(F.col("source_table"), F.col("target_table"), 16).alias("provenance_id"), *one.columns)


def run_edges(log: DataFrame, folder: str, *, checkpoint: str) -> None:
    """Write the edges of what the stream has now, a folder for each batch: a batch that is repeated writes its folder anew, and a rerun
    with the same checkpoint goes on from there. A batch reads its texts as a table of statements is read."""

    def write(batch: DataFrame, n: int) -> None:
        extract.first_of_each(extract.edge_rows(extract.extract_earliest(batch))).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    extract.eligible(log).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run_edges(log_stream(spark, sf_dir), f"{root}/edges", checkpoint=f"{root}/checkpoint")
    return extract.first_of_each(spark.read.parquet(f"{root}/edges").drop("batch"))


def throughput_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch writes the windows that it changed (update mode, so old windows leave the state) to a folder of its own, which a
    repeated batch writes anew. Counts only grow: a window's greatest is its last."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = throughput(log_stream(spark, sf_dir))

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/hours/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/hours").groupBy("hour").agg(F.max("statements").alias("statements"))
