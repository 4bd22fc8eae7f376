"""Operator 5 [native]: quality rules with cross-document line frequency.

Lines are normalised and hashed; for each host the number of documents that hold a line is counted (each document
once), lines above the host's limit are removed, and documents that keep too few of their words are rejected. The
within-text measures are computed in the document's own row. Only line hashes and counts are shuffled: the hashes of
the frequent lines, up to ``MAX_SET`` of them, become a set inside the plan, and each row drops its own lines. More of
them are joined to the lines, and the numbers of removed lines to the texts, which are shuffled then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.shared import SPACES, WORD_SPLIT, Scratch, free_name, join_counted, table, word_count, words_of

MIN_DOCS, DOC_SHARE = 10, 0.005  # a line is boilerplate in more documents of a host than both allow
MIN_KEPT = 0.5  # a document needs this share of its words on other lines
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
NGRAM = 3
MAX_SET = 100_000  # frequent lines that the plan holds; more are joined


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: int = NGRAM) -> Column:
    """Words in windows of n words that occur twice or more in the text (long). Windows are sorted by hash in the row;
    equal neighbours are repeats, and the union of their ranges is measured in word order."""
    at = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(n)]).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return _let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.when(F.size(words) > n, _let(F.array_sort(at), covered)).otherwise(F.lit(0).cast("long"))


def normal_line(line: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), WORD_SPLIT, " "))


def line_quality(
    docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, doc_share: float = DOC_SHARE, min_kept: float = MIN_KEPT, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, max_set: int = MAX_SET
) -> DataFrame:
    """``docs``, its text without the lines that are too frequent in the host, with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, line_words (words on the removed lines), base_failed and kept added; added names replace columns of
    the same name. The other measures are of the text as given. The other lines stay as they are, blank ones too; a
    rejected document's text is cleaned as well.

    A line is too frequent if more than max(min_docs, doc_share * documents of the host) documents of its host hold it;
    repeated rows are documents of their own. base_failed: fewer than ``min_words`` words, or more than
    ``max_repeated`` percent of them in repeated windows. kept: not base_failed, and at least ``min_kept`` of the words
    are on other lines. Null and blank texts have no words and fail; a null host is a host of its own. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    host, words, lines_, row, gone = (free_name(docs, c) for c in ("_host", "_words", "_lines", "_row", "_gone"))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_words", "base_failed", "kept"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    lines = F.filter(numbered, lambda x: F.trim(F.translate(x["line"], SPACES, " ")) != "")
    blank = F.translate(text, SPACES, "")
    own = docs.drop(*added).withColumn(host, F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("")))
    own = own.withColumn(words, _let(words_of(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))))
    own = own.withColumn(lines_, _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(F.transform(x, lambda y: y["line"])))).cast("long").alias("dup"), F.transform(x, lambda y: F.struct(F.xxhash64(host, normal_line(y["line"])).alias("h"), y["i"].alias("i"))).alias("each"))))
    own = own.withColumn("word_chars", F.length(blank).cast("long")).withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    own = own.withColumn("n_words", F.col(f"{words}.n")).withColumn("n_repeat_words", F.col(f"{words}.r")).withColumn("n_dup_lines", F.col(f"{lines_}.dup")).withColumn(lines_, F.col(f"{lines_}.each")).drop(words)
    own = own.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words")))
    # Row numbers are fixed by writing them: ids may be null or repeated.
    rows = scratch.save(own.withColumn(row, F.monotonically_increasing_id()))
    # The hash of a line is of its host too, so it stands for both.
    held = rows.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(lines_, lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    hosts = rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("docs"))
    frequent = held.filter(F.col("n") > min_docs).join(hosts, "host").filter(F.col("n") > doc_share * F.col("docs")).groupBy("h").agg(F.sum("n").alias("n"))
    frequent = scratch.save(frequent, narrow=True)
    hashes = [r["h"] for r in frequent.select("h").limit(max_set + 1).collect()]
    if len(hashes) <= max_set:
        found = F.transform(F.filter(lines_, lambda x: x["h"].isin(hashes)), lambda x: x["i"])
        out = rows.withColumn(gone, found).withColumn(gone, F.when(F.size(gone) > 0, F.col(gone))).drop(lines_, host, row)
    else:
        lines = rows.select(F.col(row).alias("row"), F.explode(lines_).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.i").alias("i"))
        removed = join_counted(lines, frequent, "h").groupBy("row").agg(F.collect_list("i").alias("lines")).select(F.col("row").alias(row), F.col("lines").alias(gone))
        out = rows.drop(lines_, host).join(removed, row, "left").drop(row)
    rest = _let(F.split(F.col(text_col), "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)), "\n"))
    out = out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest))
    out = out.withColumn("line_words", F.when(F.col(gone).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_words") - word_count(F.col(text_col)))).drop(gone)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("line_words") >= min_kept * F.col("n_words")))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line_words."""
    out = line_quality(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_words")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM t) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM r) GROUP BY rid),
l0 AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT rid, source, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
held AS (SELECT source, norm, count(DISTINCT rid) AS n FROM l GROUP BY source, norm),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
often AS (SELECT held.source, norm FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE n > 10 AND n > 0.005 * docs),
gone AS (SELECT rid, sum(l.n) AS n FROM l JOIN often ON l.source IS NOT DISTINCT FROM often.source AND l.norm = often.norm GROUP BY rid),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS line_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - line_words >= 0.5 * n_words AS kept FROM f
"""
