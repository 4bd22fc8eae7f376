"""Cutting the plan of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a level that may pass through the driver as a literal relation; more are written.
LOCAL_ROWS = 4_000
_WRITTEN: dict[int, tuple[str, DataFrame, str | None]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: of spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster
    is asked for the setting."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, *, after: int | None = 0, by: str | None = None, parts: int = 0) -> tuple[DataFrame, int | None]:
    """The rows of ``df`` without its plan, and their number if it is at most LOCAL_ROWS.

    A few rows become a literal relation, which Spark broadcasts. More are written to the shared folder and read again.
    ``after``: the number that the cut before gave; where that was not a few, rows are written at once and counted then. ``by``: a column
    in whose buckets, ``parts`` of them, rows are written, so that joins by it leave them where they are; ``df`` should lie in as many parts by it.
    """
    spark = df.sparkSession
    large = after is None or after > LOCAL_ROWS
    if not large:
        few = df.limit(LOCAL_ROWS + 1).toArrow()
        if few.num_rows <= LOCAL_ROWS:
            return spark.createDataFrame(few, df.schema), few.num_rows
    path = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"
    table = None if by is None else f"levels_{uuid.uuid4().hex}"
    if table is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        df.write.bucketBy(parts, by).option("path", path).saveAsTable(table)
        out = spark.table(table)
    _WRITTEN[id(out)] = (path, out, table)
    return out, (out.count() if large else None)


def drop(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames, if it did; nothing may read them any more."""
    for df in frames:
        path, _, table = _WRITTEN.pop(id(df), (None, None, None))
        if path is not None:
            spark = df.sparkSession
            if table is not None:
                spark.sql(f"DROP TABLE {table}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
