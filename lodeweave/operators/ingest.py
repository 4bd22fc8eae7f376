"""Loading a stored catalog: access probe, clearing, and a run with its modes."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.sources.scratch import cut, drop

#: The stored tables and their keys, in the order in which they are cleared.
KEYS = {"column_provenance": ["provenance_id"], "dataset_field": ["field_id"], "dataset": ["dataset_id"]}


def accessible(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Whether a stored log can be read, from one row of it at most, and what to do if not. Other errors than a missing or
    unreadable table are raised."""
    try:
        spark.read.parquet(path).limit(1).count()
    except AnalysisException as e:
        return False, f"no access to the log at {path} ({e.getCondition()}): check the path and its rights, or load fixture mappings instead"
    return True, "access confirmed"


def _path(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{table}"


def _chosen(provenance_only: bool) -> list[str]:
    return ["column_provenance"] if provenance_only else list(KEYS)


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A stored table, None before its first run."""
    if not accessible(spark, _path(folder, table))[0]:
        return None
    return spark.read.parquet(_path(folder, table))


def clear(spark: SparkSession, folder: str, *, provenance_only: bool = False) -> list[str]:
    """Empty the stored tables, or the column edges alone, keeping their schemas; the names of those that there were."""
    cleared = []
    for table in _chosen(provenance_only):
        known = stored(spark, folder, table)
        if known is not None:
            spark.createDataFrame([], known.schema).write.mode("overwrite").parquet(_path(folder, table))
            cleared.append(table)
    return cleared


def _by_keys(rows: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` whose keys ``side`` has or lacks; null is a key like others."""
    other = side.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return rows.join(other, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how)


def populate(spark: SparkSession, folder: str, tables: dict[str, DataFrame], *, dry_run: bool = False, skip_clear: bool = False, provenance_only: bool = False, unique: bool = False) -> DataFrame:
    """Load ``tables`` (by the names of KEYS) into the folder: table_name, row_count of the rows this run adds.

    A run replaces what is stored; with ``skip_clear`` it adds the rows whose keys are not stored yet, so a run that is repeated adds
    nothing. Of new rows with one key, one is loaded. ``provenance_only`` leaves datasets and fields as they are, ``dry_run``
    everything: its counts are those that the run would give. What is read of a table is fixed before the table is written.
    Keys alone are compared, and rows are moved only where some of their keys are missing. ``unique``: no key repeats in a table.
    """
    counts = []
    for table in _chosen(provenance_only):
        known, keys, new = stored(spark, folder, table), KEYS[table], tables[table]
        missing, n = None, None
        if skip_clear and known is not None:
            missing, n = cut(_by_keys(new.select(*keys), known, keys, "left_anti"))
        if dry_run or n == 0:
            rows = new.select(*keys) if missing is None else missing
            counts.append((table, (rows if unique else rows.distinct()).count()))
            continue
        if missing is not None:
            new = _by_keys(new, missing, keys, "left_semi").select(*known.columns)
        before = known.count() if missing is not None else 0
        new = new if unique else new.dropDuplicates(keys)
        new.write.mode("append" if skip_clear else "overwrite").option("compression", "zstd").parquet(_path(folder, table))
        counts.append((table, spark.read.parquet(_path(folder, table)).count() - before))
        if missing is not None:
            drop(missing)
    return spark.createDataFrame(counts, "table_name string, row_count long")
