"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of a word: space and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.size(words_of(text)).cast("long")


class Scratch:
    """Tables written to the shared folder that spark.checkpoint.dir names, to cut a plan where it would be computed again.

    A written table is computed once (checkpoint() computes its last stage twice) and survives lost executors. Where
    the setting is unset, a local session, whose executors are this machine, gets a folder of its own; a cluster is
    asked for the setting. What is no longer read can be dropped.
    """

    def __init__(self, spark: SparkSession):
        sc = spark.sparkContext
        self.spark, have = spark, sc._jsc.sc().getCheckpointDir()
        folder = have.get() if have.isDefined() else sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        self.root, self.n, self.paths = f"{folder}/tables-{uuid.uuid4().hex}", 0, {}

    def save(self, df: DataFrame, *, narrow: bool = False) -> DataFrame:
        """``narrow``: rows of a few numbers, for which a partition or two for each core of the cluster is enough. Without
        it a small table is written as one file for each shuffle partition."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        if narrow:
            df = df.coalesce(2 * self.spark.sparkContext.defaultParallelism)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables; nothing may read them any more."""
        for df in frames:
            path, _ = self.paths.pop(id(df))
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def located(scratch: Scratch, docs: DataFrame, name: str, *, stored: bool) -> DataFrame:
    """``docs`` with a column ``name`` (file, row) that tells all its rows apart and is the same whenever they are read.

    ``stored``: ``docs`` is a table of files with at most columns chosen and rows filtered, so that a row's file and its
    place there name it. Other rows, and those in memory, are written once and read back.
    """

    def with_place(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.withColumn(name, F.struct(at["file_path"].alias("file"), at["row_index"].alias("row")))

    if stored:
        try:
            return with_place(docs)
        except AnalysisException:  # rows in memory have no files
            pass
    return with_place(scratch.save(docs))


def lookup(side: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table as the side of a join: broadcast if it has at most ``most`` rows, else left to a shuffled join."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def join_counted(rows: DataFrame, side: DataFrame, key: str, *, hot: int = 1000, share: int = 20_000) -> DataFrame:
    """Inner join of ``rows`` with ``side``, a written table of one row for each key with ``n``, about how many of ``rows`` have it.

    A key of over ``hot`` rows and over one row in ``share`` is not sent to one task: there are fewer than ``share`` such
    keys, which are broadcast. Rows of the others are shuffled by key. n is dropped.
    """
    total = side.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("n") > max(hot, total // share)
    large = F.broadcast(side.filter(often).drop("n"))
    rest = rows.join(F.broadcast(side.filter(often).select(key)), key, "left_anti")
    return rows.join(large, key).unionByName(rest.join(side.filter(~often).drop("n"), key))


def place_of(df: DataFrame, name: str) -> int:
    """Which column of ``df`` has the name, as Spark compares names."""
    return [c.lower() for c in df.columns].index(name.lower())


def text_volume(docs: DataFrame, text: str = "text") -> int:
    """Characters of all texts: what group counts are sized by."""
    return int(docs.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0)


def groups_for(docs: DataFrame, text: str = "text", chars: int = 6_000_000) -> int:
    """How many groups of about ``chars`` characters the texts make: more input makes more groups, not larger ones."""
    return max(8, -(-text_volume(docs, text) // chars))


def hash_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, all of them or those of least hash ``key``; the same rows on every run.

    Where very many rows have one key, so that a cut by key would leave them all or none, places in a sort by key
    decide among them.
    """
    kept, share, out, before = df.count(), 1.0, df, None
    while kept > most:
        before, share = out, share * 0.97 * most / kept
        out = df.filter(F.pmod(key, F.lit(1 << 31)) < F.lit(int(share * (1 << 31))))
        kept = out.count()
    # A cut that leaves less than half of what was asked for fell into ties: the least rows before it, by a bounded sort.
    return before.orderBy(F.pmod(key, F.lit(1 << 31)), key).limit(most) if before is not None and kept < most // 2 else out
