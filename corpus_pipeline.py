"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage gets the documents that its predecessor wrote and returns a DataFrame; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import dart_minhash, decontaminate, mixing, sharding, toxicity
from lodeweave.llm.shared import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones among them, does not call toxic. Null and empty texts and
    documents without an id are scored as all others are; without labels nothing is toxic."""
    labelled = toxicity.with_labels(docs, table(spark, sf_dir, "labels"))
    out = toxicity.toxicity(docs, labelled, toxicity.label_categories(), key=F.xxhash64("_doc"))
    return out.filter(~F.col("toxic")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id, and of repeated rows of it the first. Documents are told
    apart by id and words, so different texts of one id are judged on their own; documents without an id or without
    words have no class and stay."""
    return dart_minhash.without_near_duplicates(docs, stored=True).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none and stay, whatever their other columns hold;
    repeated rows are judged alike."""
    out = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.filter(F.size("bench_spans") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it. A null source is a source of its own, null and repeated ids are told
    apart by their texts; a source without any word has no share, so its documents are not in the mix."""
    return mixing.take(mixing.mix(docs, stored=True)).select(*COLUMNS)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, shard and slot of each row of the mix, along the Hilbert curve. Every row gets a place, whatever is null in
    it, and repeated rows a place each."""
    out = sharding.shard(docs, stored=True)
    return out.select("doc_id", "source", "lang", F.col("shard_size").alias("size"), F.col("shard_crc32").alias("text_crc32"), "shard_key", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]
# The classifier, the signatures and the hashes of the order are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and deleted once the next stage's are written."""
    scratch, docs, before = Scratch(spark), table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
            if before is not None:  # the next stage reads this one's rows only
                scratch.drop(before)
            before = docs
    return docs
