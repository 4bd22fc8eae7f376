"""The corpus pipeline: what each stage keeps and drops."""

from __future__ import annotations

import corpus_pipeline
import pytest
from harness import SF_DIR
from pyspark.sql import functions as F

from lodeweave.llm import dart_minhash, decontaminate, mixing


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns_are_those_of_documents(stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert tuple(after.columns) == corpus_pipeline.COLUMNS, name


def test_toxicity_drops_what_is_labelled_toxic_and_little_else(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    gone = before.join(after.select("doc_id"), "doc_id", "left_anti")
    assert gone.join(labels.filter("toxic = 1"), "doc_id").count() >= 0.8 * before.join(labels.filter("toxic = 1"), "doc_id").count()
    assert gone.join(labels.filter("toxic = 0"), "doc_id").count() <= 0.05 * before.count()


def test_one_document_of_each_class_stays(stages):
    before, after = stages["near_duplicates"]
    classes = dart_minhash.near_duplicates(before).select("class_id").distinct()
    assert after.count() == classes.count()
    assert after.join(classes.withColumnRenamed("class_id", "doc_id"), "doc_id").count() == after.count()


def test_contaminated_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages["decontamination"]
    hit = decontaminate.find_contamination(before, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).filter("size(bench_spans) > 0")
    assert after.count() == before.count() - hit.count() and after.join(hit.select("doc_id"), "doc_id").count() == 0


def test_mix_and_shards(stages):
    before, after = stages["mixing"]
    assert after.count() == mixing.mix(before).agg(F.sum("mix_copies")).first()[0]
    shards = stages["sharding"][1]
    sizes = [r["count"] for r in shards.groupBy("shard").count().collect()]
    assert shards.count() == after.count() and max(sizes) - min(sizes) <= 1


def test_texts_of_one_id_are_judged_on_their_own(spark):
    rows = [(1, "w one two"), (2, "w one two"), (2, "u three"), (3, "v four"), (3, "x five"), (3, "x five"), (None, "w one two"), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()]
    assert sorted(got, key=str) == sorted([(1, "w one two"), (2, "u three"), (3, "v four"), (3, "x five"), (None, "w one two"), (4, None), (4, None)], key=str)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_odd_and_of_no_documents(spark, tmp_path, name, stage):
    """Nulls in any column, empty texts, repeated rows and ids, and columns of other names."""
    rows = [(1, None, None, None, None), (None, "no id here", "en", "a", 3), (2, "", "en", "a", 0), (5, "same words", "en", "a", 1), (5, "same words", "en", "a", 1), (5, "other words", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_at", "at", "n", "rank", "toxic", "kept", "shard", "_copy", "size"):
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(str(tmp_path / "docs"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        out = stage(spark, given, SF_DIR)
        n = {"near_duplicates": 5}.get(name, 6)
        assert name == "mixing" or out.count() == n
        assert name == "sharding" or tuple(out.columns) == corpus_pipeline.COLUMNS
        assert stage(spark, given.limit(0), SF_DIR).count() == 0
