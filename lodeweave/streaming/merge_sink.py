"""A sink that merges table edges of a stream, and the stored watermark of incremental runs.

The sink keeps one row for each table edge: the first and last time that it was seen, in how many statements, and the number
of the batch that changed it last. Rows lie in hash buckets, folders of their own. A batch reads and overwrites
the buckets that it has edges for, and leaves rows alone that it has changed already, so a batch that is repeated, wholly or
after a failure between two buckets, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import ids
from lodeweave.operators import extract
from lodeweave.operators.ingest import accessible
from lodeweave.operators.serve import upsert
from lodeweave.sources.scratch import cut, drop

BUCKETS = 16
ROLLUP = "source_table string, target_table string, first_seen timestamp, last_seen timestamp, query_count long, batch long"
WATERMARK = "source_name string, watermark timestamp, row_count long"


def table_edges(extracted: DataFrame) -> DataFrame:
    """source_table, target_table, first_seen, last_seen, query_count of a batch of edges."""
    of = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    t = extracted.select(of("src").alias("source_table"), of("tgt").alias("target_table"), F.col("start_time").cast("timestamp").alias("start_time"), "query_id")
    return t.groupBy("source_table", "target_table").agg(F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"), F.count_distinct("query_id").alias("query_count"))


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).parquet(folder) if accessible(spark, folder)[0] else None


def merge(spark: SparkSession, folder: str, new: DataFrame, batch: int, buckets: int = BUCKETS) -> None:
    """Merge the table edges of batch number ``batch`` into the sink; numbers grow, and a statement is in one batch only. The number of
    buckets of a sink is fixed by its first batch."""
    keys = ["source_table", "target_table"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    new, _ = cut(new.select("*", F.lit(batch).cast("long").alias("batch"), bucket))
    known = _stored(spark, folder, f"{ROLLUP}, bucket int")
    if known is None:
        out = new
    else:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        known = known.filter(F.col("bucket").isin(*touched)) if touched else known.limit(0)
        done = known.filter(F.col("batch") >= batch).select(*keys)
        rows = known.unionByName(new.join(done, keys, "left_anti"))
        out = rows.groupBy(*keys, "bucket").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("query_count").alias("query_count"), F.max("batch").alias("batch"))
    out, _ = cut(out, after=None)  # read before its folders are overwritten
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    drop(new, out)


def rollup(spark: SparkSession, folder: str) -> DataFrame:
    """provenance_id and what the sink has of each table edge."""
    t = _stored(spark, folder, ROLLUP)
    t = spark.createDataFrame([], ROLLUP) if t is None else t
    return t.select(ids.provenance_id(F.col("source_table"), F.col("target_table"), 16).alias("provenance_id"), "source_table", "target_table", "first_seen", "last_seen", "query_count")


def run_merged(log: DataFrame, folder: str, *, checkpoint: str) -> None:
    """Merge what a stream of statements has now into the sink; a rerun with the same checkpoint goes on from there."""

    def write(batch: DataFrame, n: int) -> None:
        merge(batch.sparkSession, folder, table_edges(extract.edge_rows(extract.extract_log(batch))), n)

    extract.eligible(log).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def watermarks(spark: SparkSession, folder: str) -> DataFrame | None:
    """source_name, watermark, row_count as stored; None before the first run."""
    return _stored(spark, folder, WATERMARK)


def run_incremental(spark: SparkSession, folder: str, log: DataFrame, *, dry_run: bool = False) -> DataFrame:
    """Statements of ``log`` after the stored watermark of their type, and, but for a dry run, the watermarks moved on.

    Sources without a new statement keep theirs. The store is replaced once, after what is read of it has been fixed. The result is fixed too:
    it is what the run has to do, whatever is stored later.
    """
    known = watermarks(spark, folder)
    todo = log
    if known is not None:
        known, _ = cut(known)  # one row for each source
        seen = known.select(F.col("source_name").alias("statement_type"), F.col("watermark").alias("_seen"))
        todo = log.join(F.broadcast(seen), "statement_type", "left").filter(F.col("_seen").isNull() | (F.col("start_time").cast("timestamp") > F.col("_seen"))).drop("_seen").select(*log.columns)
    todo, _ = cut(todo)
    if not dry_run:
        new = todo.groupBy(F.col("statement_type").alias("source_name")).agg(F.max(F.col("start_time").cast("timestamp")).alias("watermark"), F.count(F.lit(1)).alias("row_count"))
        out, _ = cut(new if known is None else upsert(known, new, ["source_name"]))
        out.write.mode("overwrite").parquet(folder)
    return todo
