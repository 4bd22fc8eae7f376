"""Operator 8 [native]: mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies. The documents of a source are put in order of
size class, the expected copies are summed up along that order, one random offset of the source is added, and a
document is emitted once for each integer that its stretch crosses. In the order of sizes every stretch of the
source takes its share of long and short documents, so the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.ranking import ranked
from lodeweave.llm.shared import Scratch, free_name, located, lookup, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
SEED = 17
BUCKET_ROWS = 20_000


def _digits(code: Column) -> Column:
    """The first seven hexadecimal digits of a code as a number below 2**28."""
    return F.conv(F.substring(code, 1, 7), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, target from (source, source_size): weights go round the sources in code point order, null last;
    what is above ``most`` times a source's size is shared again by weight.

    Filling up: with x = most * size / weight, a source is capped if its x is at most the final level of all. In the
    order of x, the level after capping the first i is (total - sum of their caps) / (weights of the others); the
    capped sources are those before the first whose x is above its level. One row for each source is sorted, no more.
    """
    n = len(weights)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1)
    s = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("free", F.col("cap") > F.col("level") * F.col("weight")).withColumn("level", F.min_by("level", F.struct(~F.col("free"), F.col("cap") / F.col("weight"), F.col("source"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("free"), F.col("level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    most_copies: float = MOST_COPIES,
    seed: int = SEED,
    stored: bool = False,
) -> DataFrame:
    """``docs`` with mix_size (words), mix_source_size, mix_target and mix_copies (how often the mix takes the row) added; added
    names replace columns of the same name.

    Every row is returned, those with no copies too; ``take`` repeats them. Null texts have size 0; a source whose
    documents have no words has target 0 and no copies. A null source is a source of its own, the last. Order and offset
    follow from the seed, the ids, sizes and texts, so reruns agree, null and repeated ids included; only rows that are
    repeated as a whole share their copies in any order. An empty table gives an empty mix.

    Narrow rows are ranked; a text is read for its size and again for the result, and moved once, to meet its copies.
    ``stored`` is that of ``located``: rows of a table of files are not written again.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    at = free_name(own, "_at")
    own = located(scratch, own, at, stored=stored)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = own.select(F.col(at).alias("at"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(name).alias("code"), F.xxhash64(text_col).alias("text_hash"))
    # Size classes, a quarter of a power of two wide; in each, documents of up to BUCKET_ROWS by size, bucket after bucket.
    rows = scratch.save(rows.withColumn("class", F.floor(4 * F.log2(F.col("size") + 1))))
    cells = rows.groupBy(F.col("source").alias("of"), F.col("class").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("buckets"))
    cells = lookup(scratch.save(cells, narrow=True))
    placed = rows.join(cells, rows["source"].eqNullSafe(cells["of"]) & (rows["class"] == cells["cell"])).drop("of", "cell")
    placed = scratch.save(placed.withColumn("bucket", F.pmod(_digits(F.col("code")), F.col("buckets"))).drop("buckets"))
    scratch.drop(rows)
    order = [F.col(c) for c in ("source", "class", "bucket", "size", "code", "text_hash", "at.file", "at.row")]
    rank = ranked(scratch, placed, order)
    scratch.drop(placed)
    sources = scratch.save(rank.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("rank").alias("first")), narrow=True)
    goal = sources.select(F.col("source").alias("of"), "first").join(targets(sources.drop("first"), weights, most_copies), F.col("of").eqNullSafe(F.col("source"))).drop("source")
    goal = lookup(scratch.save(goal, narrow=True))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _digits(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit(""))))).cast("double") / F.lit(float(1 << 28))
    place = F.col("rank") - F.col("first")
    copies = F.floor(each * (place + 1) + offset) - F.floor(each * place + offset)
    found = rank.join(goal, F.col("source").eqNullSafe(F.col("of")))
    found = found.select(F.col("at").alias(at), F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.cast("long").alias("mix_copies"))
    return own.join(found, at).drop(at)


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as mix_copies says, with the columns that the documents had."""
    own = [c for c in mixed.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]
    copy = free_name(mixed, "_copy")
    return mixed.filter("mix_copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in own])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) of every document."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), stored=True)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
v AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS k
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
x AS (SELECT *, cap > level * weight AS free FROM v),
g AS (SELECT source, source_size, CASE WHEN free THEN (SELECT level FROM x WHERE free ORDER BY k LIMIT 1) * weight ELSE cap END AS target FROM x),
c AS (SELECT *, floor(4 * log2(size + 1)) AS class, '17:' || coalesce(CAST(doc_id AS VARCHAR), '') AS name FROM d),
b AS (SELECT *, CAST('0x' || substr(md5(name), 1, 7) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY source, class) / 20000.0) AS BIGINT) AS bucket FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, md5(name)) - 1 AS rank FROM b),
e AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, r.rank, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS each,
         CAST('0x' || substr(md5('17/' || coalesce(r.source, '')), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS shift
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST((floor(each * (rank + 1) + shift) - floor(each * rank + shift)) * size AS BIGINT) AS taken FROM e
"""
