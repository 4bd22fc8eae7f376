"""The merging sink, stored watermarks, the trigram index and constraints beyond their queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import constraints, trigrams
from lodeweave.streaming import log_stream, merge_sink

LOG = "query_id long, statement_type string, start_time timestamp, default_database string, error_code int, sql_row_no int, sql_text string"


def log_rows(spark, ids):
    at = F.timestamp_seconds(F.col("query_id") * 3600)
    text = F.format_string("INSERT INTO t%d (a) SELECT x FROM u%d", F.col("query_id") % 3, F.col("query_id") % 2)
    return spark.createDataFrame([(i,) for i in ids], "query_id long").select("query_id", F.lit("Insert").alias("statement_type"), at.alias("start_time"), F.lit("d").alias("default_database"), F.lit(0).alias("error_code"), F.lit(1).alias("sql_row_no"), text.alias("sql_text"))


def sink_rows(df):
    return sorted((r["source_table"], r["target_table"], str(r["first_seen"]), str(r["last_seen"]), r["query_count"]) for r in df.collect())


def test_stream_over_split_files_equals_the_batch(spark, tmp_path):
    from lodeweave.operators import extract

    files, sink, checkpoint = (f"{tmp_path}/{x}" for x in ("log", "sink", "checkpoint"))
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(files)
    for ids in (range(0, 20), range(20, 50)):
        log_rows(spark, ids).coalesce(1).write.mode("append").parquet(files)
        if ids.start:
            log_rows(spark, range(50, 52)).coalesce(1).write.mode("append").parquet(files)
        merge_sink.run_merged(stream(), sink, checkpoint=checkpoint)
    want = log_stream.table_rollup(extract.edge_rows(extract.extract_log(log_rows(spark, range(52)))))
    assert sink_rows(merge_sink.rollup(spark, sink)) == sink_rows(want)


def test_repeated_batches_change_nothing(spark, tmp_path):
    sink = f"{tmp_path}/sink"
    schema = "source_table string, target_table string, first_seen timestamp, last_seen timestamp, query_count long"
    day = lambda k: __import__("datetime").datetime(2024, 1, k)
    one = spark.createDataFrame([(f"s{i}", "t", day(3), day(4), 2) for i in range(30)], schema)
    two = spark.createDataFrame([(f"s{i}", "t", day(1 if i % 2 else 5), day(9), 1) for i in range(20, 40)], schema)
    assert merge_sink.rollup(spark, sink).count() == 0
    merge_sink.merge(spark, sink, one, 0)
    merge_sink.merge(spark, sink, one, 0)
    merge_sink.merge(spark, sink, two, 1)
    once = sink_rows(merge_sink.rollup(spark, sink))
    merge_sink.merge(spark, sink, two, 1)
    merge_sink.merge(spark, sink, two.limit(0), 2)
    assert sink_rows(merge_sink.rollup(spark, sink)) == once and len(once) == 40
    assert {r[0]: r[2:] for r in once}["s21"] == ("2024-01-01 00:00:00", "2024-01-09 00:00:00", 3)


def test_watermarks_are_read_back(spark, tmp_path):
    folder = f"{tmp_path}/watermarks"
    assert merge_sink.watermarks(spark, folder) is None
    run = lambda ids, **k: sorted(r["query_id"] for r in merge_sink.run_incremental(spark, folder, log_rows(spark, ids), **k).collect())
    assert run(range(3), dry_run=True) == [0, 1, 2] and merge_sink.watermarks(spark, folder) is None
    assert run(range(3)) == [0, 1, 2] and run(range(5)) == [3, 4] and run(range(5)) == []
    assert [(r["source_name"], r["row_count"]) for r in merge_sink.watermarks(spark, folder).collect()] == [("Insert", 2)]


@pytest.mark.parametrize("sought", ["ab", "abc", "ABCab", "äöü", "zzz", "a.b", "%_x", "aaaa"])
def test_index_finds_what_a_scan_finds(spark, tmp_path, sought):
    names = ["xabcaby", "ABC", "cab", "äÖüß", None, "", "a.b.c", "axb", "100%_x", "aaaa", "aaa", "bca abc"]
    df = spark.createDataFrame([(f"i{k}", n, names[-k]) for k, n in enumerate(names)], "key string, name string, other string")
    trigrams.build(df, "key", ["name", "other"], str(tmp_path))
    got = sorted(r["key"] for r in trigrams.search(df, "key", ["name", "other"], str(tmp_path), sought).collect())
    assert got == sorted(f"i{k}" for k, n in enumerate(names) if any(x and sought.lower() in x.lower() for x in (n, names[-k])))


def test_search_reads_only_the_lists_it_needs(spark, tmp_path):
    df = spark.range(2000).selectExpr("CAST(id AS STRING) AS key", "concat('name', conv(id * 7919, 10, 36)) AS name")
    trigrams.build(df, "key", ["name"], str(tmp_path))
    plan = trigrams.candidates(spark, str(tmp_path), "me1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "gram" in plan.split("PushedFilters")[1].split("]")[0]
    with pytest.raises(ValueError):
        trigrams.candidates(spark, str(tmp_path), "me")


def test_rules_over_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (7, None)], "n int, t string")
    rules = {"small": F.col("n") < 5, "lettered": F.col("t").isNotNull()}
    assert sorted(map(tuple, constraints.domain_report(df, rules).collect())) == [("lettered", 3, 1), ("small", 3, 2)]
    assert sorted(map(tuple, constraints.domain_report(df.limit(0), rules).collect())) == [("lettered", 0, 0), ("small", 0, 0)]
    known = spark.createDataFrame([("a",), ("a",)], "k string")
    assert list(map(tuple, constraints.reference_report(df, {"t": F.col("t")}, known, "k").collect())) == [("t", 2, 1)]
    assert [tuple(r) for r in constraints.presence_report(spark, {"X": df}, {"X": "n t u", "Y": "a"}).collect()] == [("columns of X", 3, 1), ("columns of Y", 1, 1)]
