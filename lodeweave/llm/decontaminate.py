"""Operator 9 [native]: benchmark decontamination with a broadcast hash set of test n-grams.

The normalised n-grams of the benchmark, at most ``MAX_SET`` of them, become a hash set inside the plan (an IN
predicate over literals, which Spark evaluates as a set lookup). Each document is scanned in its own row: the
hash of each window is looked up, a hit is verified by its words, and hits become spans. Nothing is exploded or
shuffled but the few hits. A larger benchmark takes a shuffled join of the hashes of distinct texts' windows instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.shared import Scratch, free_name, join_counted, table

WINDOW = 10
MAX_SET = 100_000
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = "array<struct<start:int,len:int,h:bigint>>"


def normal_words(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased; empty for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), NOT_WORD), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _gram(words: Column, start: Column, size: int) -> Column:
    return F.slice(words, start + 1, size)


def benchmark_grams(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item, len, gram, h: each window of each item; an item of fewer words, but not none, is one window."""
    words = items.select(F.col(id_col).cast("string").alias("item"), normal_words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    at = words.select("item", "w", size.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("i"))
    cut = F.slice("w", F.col("i") + 1, F.col("len"))
    return at.select("item", "len", F.array_join(cut, " ").alias("gram"), F.xxhash64(cut).alias("h")).distinct()


def _scan_length(words: Column, size: int, grams: list[tuple[str, int]]) -> Column:
    hashes, texts = sorted({h for _, h in grams}), sorted({g for g, _ in grams})
    heads = sorted({" ".join(g.split(" ")[:2]) for g in texts})

    def hit(i: Column) -> Column:
        cut = _gram(words, i, size)
        full = F.xxhash64(cut).isin(hashes) & F.array_join(cut, " ").isin(texts)
        # The first two words rule most windows out, at a fifth of the work.
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)).isin(heads) & full if size > 1 else full

    def described(i: Column) -> Column:
        return F.struct(i.alias("start"), F.lit(size).alias("len"), F.xxhash64(_gram(words, i, size)).alias("h"))

    starts = F.when(F.size(words) >= size, F.filter(F.sequence(F.lit(0), F.size(words) - size), hit)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, described)


def _scan(words: Column, by_len: dict[int, list[tuple[str, int]]]) -> Column:
    """Verified hits of one text, for each window length that the benchmark has."""
    found = [_scan_length(words, size, grams) for size, grams in sorted(by_len.items())]
    return F.concat(*found) if found else F.array().cast(_HITS)


def _spans(hits: Column) -> Column:
    """Maximal covered runs of words (start, end exclusive) of hits in any order."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), end.alias("end")))))

    return F.when(F.size(hits) == 0, empty).otherwise(F.aggregate(F.array_sort(hits), empty, add))


def _joined_hits(docs: DataFrame, grams: DataFrame, text_col: str) -> DataFrame:
    """content, hits of each distinct text with hits, by a shuffled join: for benchmarks beyond MAX_SET. Windows are shuffled as
    hashes; what meets a window of the benchmark is compared by its words, which stay with the text. A window that very many
    texts have is met in SALTS places: the benchmark's windows, which are far fewer than those of the texts, go to each."""
    texts = docs.select(F.unhex(F.sha2(text_col, 256)).alias("content"), F.col(text_col).alias("t")).groupBy("content").agg(F.first("t").alias("t"))
    words = texts.select("content", normal_words(F.col("t")).alias("w"))
    sizes = grams.select("len").distinct()
    at = words.crossJoin(F.broadcast(sizes)).filter(F.size("w") >= F.col("len"))  # at most `window` lengths, one row each
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda i: F.xxhash64(F.slice("w", i + 1, F.col("len"))))
    at = at.select("content", "len", F.posexplode(hashes).alias("start", "h"))
    at = at.withColumn("salt", F.pmod(F.xxhash64("content", F.lit("salt")), F.lit(SALTS)).cast("int"))
    spread = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = at.join(spread, ["len", "h", "salt"]).groupBy("content").agg(F.collect_list(F.struct("start", F.col("len").cast("int").alias("len"), "h", "gram")).alias("found"))
    same = F.filter("found", lambda x: F.array_join(F.slice("w", x["start"] + 1, x["len"]), " ") == x["gram"])
    hits = F.transform(same, lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), x["h"].alias("h")))
    return words.join(found, "content").select("content", hits.alias("hits"))


def find_contamination(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_set: int = MAX_SET
) -> DataFrame:
    """``docs`` with bench_words (long), bench_spans (covered word ranges, end exclusive) and bench_items (sorted ids of the
    items with a window in the text, as strings) added; added names replace columns of the same name.

    Null and blank texts have no words and no hits; items without words have no windows, repeated items count once. Items
    without an id count as one, which is null in bench_items, at its end. Repeated rows are judged alike. An empty
    benchmark leaves every document clean; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    grams = scratch.save(benchmark_grams(items, item_id, item_text, window))
    distinct = grams.select("len", "gram", "h").distinct()
    own = docs.drop("bench_words", "bench_spans", "bench_items")
    scan, hits, windows, group = (free_name(own, c) for c in ("_scan", "_hits", "_windows", "_set"))
    known = distinct.limit(max_set + 1).collect()
    if len(known) <= max_set:
        by_len: dict[int, list[tuple[str, int]]] = {}
        for r in known:
            by_len.setdefault(r["len"], []).append((r["gram"], r["h"]))
        scanned = own.withColumn(scan, _let(normal_words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _scan(w, by_len).alias("hits"))))
        scanned = scanned.withColumn("bench_words", F.col(f"{scan}.n")).withColumn(hits, F.col(f"{scan}.hits")).drop(scan)
    else:
        found = _joined_hits(docs, distinct, text_col).select(F.col("content").alias(scan), F.col("hits").alias(hits))
        scanned = own.withColumn(scan, F.unhex(F.sha2(text_col, 256))).join(found, scan, "left").drop(scan)
        scanned = scanned.withColumn("bench_words", F.size(normal_words(F.col(text_col))).cast("long")).withColumn(hits, F.coalesce(hits, F.array().cast(_HITS)))
    scanned = scanned.withColumn("bench_spans", _spans(F.col(hits)))
    # Which items a text hits follows from its set of windows: looked up once for each such set, and not by id.
    scanned = scanned.withColumn(windows, F.array_sort(F.array_distinct(F.transform(hits, lambda x: F.struct(x["len"].alias("len"), x["h"].alias("h")))))).drop(hits)
    scanned = scratch.save(scanned.withColumn(group, F.when(F.size(windows) > 0, F.md5(F.to_json(windows)))))
    sets = scanned.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("set")).agg(F.first(windows).alias("w"), F.count(F.lit(1)).alias("n"))
    sets = scratch.save(sets, narrow=True)
    each = sets.select("set", "n", F.explode("w").alias("w")).select("set", "n", "w.len", "w.h").join(grams.select("len", "h", "item").distinct(), ["len", "h"])
    # In a struct, an item without an id is collected too.
    items_of = each.groupBy("set", "n").agg(F.array_sort(F.transform(F.collect_set(F.struct("item")), lambda x: x["item"])).alias("bench_items"))
    items_of = scratch.save(items_of.withColumnRenamed("set", group), narrow=True)
    clean = scanned.filter(F.col(group).isNull()).withColumn("bench_items", F.array().cast("array<string>"))
    # A passage may be on very many rows: their set is not sent to one task then.
    dirty = join_counted(scanned.filter(F.col(group).isNotNull()), items_of, group)
    return dirty.unionByName(clean).drop(group, windows)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    out = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = hit_words(F.col("bench_spans"))
    return out.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT rid, p.n, i, item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
