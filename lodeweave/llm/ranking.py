"""Ranks over a whole table without a sort in one task.

Rows are dealt to ranges of the order, sorted there and numbered; the counts of the ranges, one number for each task, add
up to each range's first rank. The order ends in what tells all rows apart, so no range grows with ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.shared import Scratch

RANGE_ROWS = 1_000_000
_IN_RANGE = 33  # bits of monotonically_increasing_id() that number the rows of a task


def ranked(scratch: Scratch, rows: DataFrame, order: list[Column], *, weight: str | None = None) -> DataFrame:
    """``rows``, a written table, with rank added: how many rows come before in ``order``, or the sum of their ``weight``.

    ``order`` should be total; rows that it leaves equal get ranks next to each other in any order.
    """
    parts = max(scratch.spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    dealt = scratch.save(dealt.withColumn("range", F.shiftright("_n", _IN_RANGE)).withColumn("before", F.col("_n").bitwiseAND((1 << _IN_RANGE) - 1)).drop("_n"))
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("range").agg(size.alias("size")).select("range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first"))
    if weight is not None:
        above = Window.partitionBy("range").orderBy("before").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn("before", F.coalesce(F.sum(weight).over(above), F.lit(0)))
    # One row for each range: as many as the sort has tasks.
    return dealt.join(F.broadcast(first), "range").withColumn("rank", F.col("first") + F.col("before")).drop("range", "before", "first")
