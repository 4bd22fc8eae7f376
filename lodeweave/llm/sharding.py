"""Operator 10: sharding along a Hilbert curve over document metadata.

Language, source, size and id are quantised to ``bits`` bits each, so that each value takes its share of the rows:
numbers are cut at quantiles, names are ordered and cut by the rows before them. Codes keep the order of values. Rows
are ordered by their index on the Hilbert curve of the four codes, so a shard is a run of the curve: a few boxes, with
a range of values in every dimension that file statistics can prune by. Runs are cut by rank: the shards' counts are at most
one apart (law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodeweave.llm.ranking import ranked
from lodeweave.llm.shared import Scratch, free_name, located, lookup, table

SHARDS, BITS = 40, 4


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with ``bits`` bits in each axis (Skilling's transform, all points at once)."""
    x = [np.asarray(a, np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the inverse
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def _cells(bits: int):
    @F.pandas_udf("long")
    def cell(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy(), d.to_numpy()], bits))

    return cell


def _quantile_codes(rows: DataFrame, names: list[str], places: int) -> list[Column]:
    """A code in 0..places-1 of each numeric column of ``rows``, null 0: how many of the column's quantiles are at most its value."""
    shares = [k / places for k in range(1, places)]
    # Sketches of all rows, merged; a few numbers for each column reach the driver.
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in names]).first()
    out = []
    for c in names:
        cuts = sorted({x for x in found[c] or [] if x is not None})
        above = [(F.col(c) >= F.lit(x)).cast("int") for x in cuts]
        out.append(F.coalesce(sum(above[1:], above[0]) if above else F.lit(0), F.lit(0)).cast("int"))
    return out


def _name_codes(scratch: Scratch, rows: DataFrame, name: str, places: int) -> DataFrame:
    """``rows`` with the column ``name`` replaced by a code in 0..places-1 in order of its values, null first: up to ``places`` values
    are numbered, more take the share of the rows before them. Only distinct values are sorted."""
    values = scratch.save(rows.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n")), narrow=True)
    few = values.count() <= places
    total = values.agg(F.count(F.lit(1)) if few else F.sum("n")).first()[0] or 1
    before = ranked(scratch, values, [F.col("value")], weight=None if few else "n")
    codes = lookup(scratch.save(before.select("value", F.floor(F.col("rank") * places / total).cast("int").alias("code")), narrow=True))
    return rows.join(codes, rows[name].eqNullSafe(codes["value"])).drop("value", name).withColumnRenamed("code", name)


def shard(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", shards: int = SHARDS, bits: int = BITS, stored: bool = False
) -> DataFrame:
    """``docs`` with shard_size (UTF-8 bytes and 16), shard_crc32, shard_key (curve index), shard (0 to shards - 1) and slot
    (gapless from 0 in each shard) added; added names replace columns of the same name.

    Nulls in any column have a place on each axis, a null text has no bytes. Equal curve positions are ordered by a hash of id and
    text, then by the row's place in its file, so ties, repeated rows and a position with very many rows are spread over
    ranks without gathering them. Columns that are not numbers (a doc_id may be a string) are coded as names.
    With fewer rows than shards some shards are empty; an empty table gives an empty result.

    Only narrow rows are sorted; texts are read for their size and joined by no other way than a row's place. ``stored``
    is that of ``located``.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.drop("shard_size", "shard_crc32", "shard_key", "shard", "slot")
    at = free_name(own, "_at")
    own = located(scratch, own, at, stored=stored)
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = own.select(F.col(at).alias("at"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("crc"))
    rows = scratch.save(rows.withColumn("spread", F.xxhash64("id", "crc")))
    axes = ("lang", "source", "size", "id")
    numeric = [c for c in axes if isinstance(rows.schema[c].dataType, NumericType)]
    codes = dict(zip(numeric, _quantile_codes(rows, numeric, 1 << bits)))
    coded = rows.withColumns({c: F.col(c) for c in axes} | {f"{c}_code": code for c, code in codes.items()})
    for c in axes:
        if c not in numeric:
            coded = _name_codes(scratch, coded, c, 1 << bits).withColumnRenamed(c, f"{c}_code")
    placed = scratch.save(coded.select("at", "size", "crc", "spread", _cells(bits)(*[F.col(f"{c}_code") for c in axes]).alias("key")))
    total = placed.count()
    rank = ranked(scratch, placed, [F.col(c) for c in ("key", "spread", "crc", "at.file", "at.row")])
    scratch.drop(rows, placed)
    # The least rank r with floor(r * shards / total) = k is ceil(k * total / shards).
    k = F.expr(f"cast((rank * {shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(cast(shard as long) * {total}L + {shards - 1}L) div {shards}L")
    rank = rank.withColumn("shard", k).withColumn("slot", F.col("rank") - first)
    found = rank.select(F.col("at").alias(at), F.col("size").alias("shard_size"), F.col("crc").alias("shard_crc32"), F.col("key").alias("shard_key"), "shard", "slot")
    return own.join(found, at).drop(at)


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``) and curve index of every document."""
    out = shard(table(spark, sf_dir, "documents"), stored=True)
    return out.select("doc_id", F.col("shard_size").alias("size"), F.col("shard_crc32").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "shard_key")
