"""Surrogate keys without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.sources.scratch import cut

CELL = 65_536
MOST_ROWS = 1_000_000  # rows of a cell that one task numbers
_PLACE = 33  # bits of monotonically_increasing_id() that number the rows of a task


def _before(counts: DataFrame, by: str) -> DataFrame:
    """_of, _first: how many rows the cells before each cell have. ``counts``: ``by``, _n; one row for each cell."""
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(F.col(by).alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))


def _dealt(df: DataFrame, order: list[str | Column], parts: int) -> DataFrame:
    """``df`` with _cell and _own, from a range sort by ``order``; a row's place in its task splits rows that ``order`` leaves equal."""
    order = [*order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    rows, _ = cut(rows.withColumn("_at", F.monotonically_increasing_id()), after=None)  # written: its ranges differ when they are drawn again
    own = F.col("_at").bitwiseAND((1 << _PLACE) - 1) + 1
    return rows.withColumn("_cell", F.shiftright("_at", _PLACE)).withColumn("_own", own).drop("_at")


def running(df: DataFrame, name: str, key: str, amount: str, *, cell: int = CELL) -> DataFrame:
    """``df`` (``key`` a whole number, distinct and not null) with ``name``: the sum of ``amount`` over all lesser keys, by cells as in ``numbered``."""
    place = df.withColumn("_cell", F.floor(F.col(key) / cell))
    sums = place.groupBy("_cell").agg(F.sum(amount).alias("_n"))
    own = F.sum(amount).over(Window.partitionBy("_cell").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    found = place.withColumn("_own", F.coalesce(own, F.lit(0))).join(_before(sums, "_cell"), F.col("_cell") == F.col("_of"))
    return found.withColumn(name, F.col("_first") + F.col("_own")).drop("_cell", "_of", "_own", "_first")


def numbered(df: DataFrame, name: str, key: str, then: list[str | Column] | None = None, *, unique: bool = False, cell: int = CELL, most: int = MOST_ROWS) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3, ... by the whole number ``key``, null first, then by ``then``.

    Keys fall into ordered cells of ``cell`` values, null into one of its own. The rows of a cell are numbered by a window; the first
    number of a cell is a running sum over the cells' counts, one row for each cell. Where a cell has over ``most`` rows, as
    a key or null is repeated very often, the rows are dealt to ranges of key and ``then`` instead, written, and numbered
    there. Rows equal in both are numbered in any order.

    ``unique``: the key is known to be that of the rows, or nearly, so that a cell has about ``cell`` rows at most. All is one
    plan then, without a count before it; a key that repeats after all gives the same numbers, in larger tasks.
    """
    then = then or []
    place = df.withColumn("_cell", F.floor(F.col(key) / cell))
    counts, size = place.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")), None
    if not unique:
        counts, _ = cut(counts)
        size = counts.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    if size is not None and (size["most"] or 0) > most:
        place = _dealt(df, [key, *then], max(df.sparkSession.sparkContext.defaultParallelism, -(-size["all"] // most)))
        counts = place.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    else:
        place = place.withColumn("_own", F.row_number().over(Window.partitionBy("_cell").orderBy(key, *then)))
    found = place.join(_before(counts, "_cell"), F.col("_cell").eqNullSafe(F.col("_of")))
    return found.withColumn(name, F.col("_first") + F.col("_own")).drop("_cell", "_of", "_own", "_first")
