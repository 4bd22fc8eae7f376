"""Search by an inverted index of trigrams.

The index has a row for each trigram of a text and the text's id, sorted by trigram, so that the statistics of its files
leave out what a search does not need. A search intersects the lists of the trigrams of what is sought by counting, and verifies
the few texts that have them all. Texts that are put together from the values of some columns have an index of the values instead, of which there
are far fewer than of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.sources.scratch import cut

SIZE = 3


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case; none for shorter texts and null."""
    low = F.lower(text)
    at = F.when(F.length(low) >= SIZE, F.sequence(F.lit(1), F.length(low) - (SIZE - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda k: F.substr(low, k, F.lit(SIZE))))


def build(texts: DataFrame, id_col: str, text_cols: list[str], folder: str) -> None:
    """Write the index of ``texts`` into the folder. Trigrams are dealt to ranges together with ids, so one that very many texts have is
    shared by several files."""
    each = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(F.col(c)), F.array().cast("array<string>")) for c in text_cols])))).alias("gram"))
    each.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(folder)


def candidates(spark: SparkSession, folder: str, sought: str) -> DataFrame:
    """id of the texts that have all trigrams of ``sought`` (three characters at least)."""
    low = sought.lower()
    parts = sorted({low[k : k + SIZE] for k in range(len(low) - SIZE + 1)})
    if not parts:
        raise ValueError(f"an index of trigrams needs at least {SIZE} characters to search for")
    lists = spark.read.schema("id string, gram string").parquet(folder).filter(F.col("gram").isin(*parts))
    return lists.select("id") if len(parts) == 1 else lists.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(parts)).select("id")


def search(texts: DataFrame, id_col: str, text_cols: list[str], folder: str, sought: str) -> DataFrame:
    """Rows of ``texts`` one of whose columns has ``sought``, in any case of letters. What is shorter than a trigram is sought in all
    texts, without the index."""
    hit = F.lit(False)
    for c in text_cols:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(sought.lower()))
    if len(sought) >= SIZE:
        found = candidates(texts.sparkSession, folder, sought).withColumnRenamed("id", id_col)
        texts = texts.join(found, id_col, "left_semi")
    return texts.filter(hit)


def build_parts(parts: dict[str, DataFrame], folder: str) -> None:
    """Write an index of the distinct values of each part: frames of one column, which hold all values that the part has in the texts."""
    for name, values in parts.items():
        build(values.toDF("value").distinct(), "value", ["value"], f"{folder}/{name}")


def search_parts(texts: DataFrame, parts: list[str], folder: str, sought: str, point: str = ".") -> DataFrame:
    """Rows of ``texts`` whose ``parts``, joined by points, have ``sought``, in any case of letters. What of it lies between points lies
    within one part, so its longest piece is looked up among the values of each; a piece shorter than a trigram is sought in all texts."""
    hit = F.contains(F.lower(F.concat_ws(point, *parts)), F.lit(sought.lower()))
    piece = max(sought.lower().split(point), key=len)
    if len(piece) < SIZE:
        return texts.filter(hit)
    out, rest = None, texts
    for name in parts:
        found, n = cut(candidates(texts.sparkSession, f"{folder}/{name}", piece).filter(F.contains(F.lower("id"), F.lit(piece))).withColumnRenamed("id", name))
        if n == 0:
            continue
        some = rest.join(found, name, "left_semi")
        out, rest = some if out is None else out.unionByName(some), rest.join(found, name, "left_anti")
    return texts.limit(0) if out is None else out.select(*texts.columns).filter(hit)
