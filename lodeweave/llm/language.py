"""Operator 4: language identification by word-first backoff.

A word that the training texts have often is scored by its log frequency in each language. An unseen word backs off
to its character n-grams, longest first: the n-grams of the longest length of which any is known score it, by the
mean of their log frequencies. A text is scored by the sum over its words; the softmax of the sums gives the score.

The model is counted over a bounded sample of the labelled texts of each language, and the words and n-grams of each length
that a language has most often are kept up to a number for each language. So the tables that tasks get do not grow with the
input, and a language that few texts have is learned from all of them, whatever else there is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.shared import Scratch, place_of, table
from lodeweave.llm.textscan import mix

SAMPLE = 4_000  # labelled texts of a language to learn from, about, where it has more: those of least hash
LONGEST = 4
MOST_WORDS, MOST_GRAMS = 20_000, 20_000  # of a language; n-grams: of each length
UNKNOWN = "und"
CHUNK_CHARS = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EDGE = 1  # a code point that no letter has marks both ends of a word
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


class Words:
    """Lower-cased words (runs of letters) of a chunk of texts, as code points with an edge mark on both sides."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        self.texts = len(texts)
        points = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[points]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        ends_of_text = 1 + np.cumsum([len(t) + 1 for t in lower]) if lower else np.zeros(0, np.int64)
        self.of = np.searchsorted(ends_of_text, self.starts, "right")
        self.points = np.where(letter, points, _EDGE).astype(np.uint64)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each run of code points."""
        h, length = np.zeros(len(starts), np.uint64), ends - starts
        live, k = np.arange(len(starts)), 0
        while len(live):
            h[live] = mix(h[live] * _GOLD + self.points[starts[live] + k] + np.uint64(1))
            k += 1
            live = live[length[live] > k]
        return h

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``words``, hash) of the n-grams of each word with its edges; single letters are without edges."""
        a, b = self.starts[words] - (n > 1), self.ends[words] + (n > 1)
        count = np.maximum(b - a - n + 1, 0)
        which = np.repeat(np.arange(len(words)), count)
        at = a[which] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = mix(h * _GOLD + self.points[at + k])
        return which, h


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    texts, start, size = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        texts.append(t or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARS:
            yield start, i + 1, Words(texts)
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, start + len(texts), Words(texts)


class Table:
    """Log frequencies of keys by language, add-one smoothed; looked up by hash. ``totals``: of each language, all its keys."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        self.keys, at = np.unique(keys, return_inverse=True)
        by = np.zeros((len(self.keys), len(totals)))
        np.add.at(by, (at, langs), counts)
        self.logs = np.log((by + 0.5) / (totals + 0.5 * (len(self.keys) + 1))).astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its row."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


class Model:
    def __init__(self, langs: list[str], words: Table, grams: list[Table]):
        self.langs, self.words, self.grams = langs, words, grams

    def score_words(self, w: Words, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Log frequency of each of ``words`` in each language, backing off from the word to shorter n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        found, row = self.words.find(hashes)
        out[found] = self.words.logs[row[found]]
        left = np.flatnonzero(~found)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            which, h = w.grams(words[left], n)
            known, row = self.grams[n - 1].find(h)
            which, row = which[known], row[known]
            hits = np.bincount(which, minlength=len(left))
            sums = np.zeros((len(left), len(self.langs)))
            for k in range(len(self.langs)):
                sums[:, k] = np.bincount(which, self.grams[n - 1].logs[row, k], len(left))
            some = hits > 0
            out[left[some]] = sums[some] / hits[some, None]
            left = left[~some]
        return out

    def predict(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(language number, or -1 without words; score) of each text. Each distinct word is scored once."""
        hashes = w.hashes(w.starts, w.ends)
        distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        scores = self.score_words(w, first, distinct)
        n = np.bincount(w.of, minlength=w.texts)
        total = np.column_stack([np.bincount(w.of, scores[at, k], w.texts) for k in range(len(self.langs))]) if self.langs else np.zeros((w.texts, 0))
        if not self.langs:
            return np.full(w.texts, -1), np.zeros(w.texts)
        best = total.argmax(1)  # a tie goes to the first language
        share = np.exp(total - total.max(1, keepdims=True))
        return np.where(n > 0, best, -1), np.where(n > 0, 1 / share.sum(1), 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind (0: word, n: n-gram), key, lang, count of each batch of labelled texts."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j, w in _chunks(batch.column("text")):
            for lang in sorted(set(langs[i:j])):
                mine = np.flatnonzero((langs[i:j] == lang)[w.of])
                for n in range(LONGEST + 1):
                    h = w.hashes(w.starts[mine], w.ends[mine]) if n == 0 else w.grams(mine, n)[1]
                    keys, counts = np.unique(h, return_counts=True)
                    m = len(keys)
                    yield pa.record_batch([pa.array(np.full(m, n, np.int32)), pa.array(keys.view(np.int64)), pa.array([lang] * m, pa.string()), pa.array(counts, pa.int64())], ["kind", "key", "lang", "n"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("total", pa.int64())])
    t = pa.concat_tables([schema.empty_table(), *(pa.Table.from_batches([b]).cast(schema) for b in batches)])
    langs = sorted(set(t.column("lang").to_pylist()))
    number = np.searchsorted(np.array(langs), np.array(t.column("lang").to_pylist(), str)) if langs else np.zeros(0, np.int64)
    kind, key, n, total = t.column("kind").to_numpy(), t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy(), t.column("total").to_numpy()
    tables = []
    for k in range(LONGEST + 1):
        m, totals = kind == k, np.zeros(len(langs))
        totals[number[m]] = total[m]
        tables.append(Table(key[m], number[m], n[m], totals))
    yield pa.record_batch([pa.array([pickle.dumps((langs, tables))], pa.binary())], ["model"])


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """text, lang of about ``sample`` rows of each language, or all of one that has fewer: those of least hash ``key``. Rows that repeat a
    text under one key count once."""
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(sample) / F.col("n"))
    kept = rows.join(F.broadcast(counts), "lang").filter(F.pmod("key", F.lit(1 << 31)) < share * (1 << 31))  # one row for each language
    return kept.groupBy("lang", "key", F.xxhash64("text").alias("of")).agg(F.first("text").alias("text")).select("text", "lang")


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, sample: int = SAMPLE, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Model:
    """A model of the rows with a text and a language: of about ``sample`` of each language, and of ``most_words`` and ``most_grams`` keys of
    each that it has most often, ties by hash. What one language keeps is counted in all. The number of languages is taken to be that
    of names of languages: a few thousand at most."""
    key = F.xxhash64(text_col) if key is None else key
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(key.alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = sampled(rows, sample).select("text", "lang").mapInArrow(_count, "kind int, key long, lang string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    counts = Scratch(labelled.sparkSession).save(counts, narrow=True)
    often = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "key"))
    kept = counts.withColumn("_rank", often).filter(F.col("_rank") <= F.when(F.col("kind") == 0, most_words).otherwise(most_grams)).select("kind", "key").distinct()
    totals = counts.groupBy("kind", "lang").agg(F.sum("n").alias("total"))
    model = counts.join(kept, ["kind", "key"]).join(F.broadcast(totals), ["kind", "lang"]).select("kind", "key", "lang", "n", "total")
    found = model.repartition(1).mapInArrow(_build, "model binary").first()
    if found is None:  # nothing to learn from
        none = np.zeros(0, np.int64)
        return Model([], *(lambda t: (t, [t] * LONGEST))(Table(none.view(np.uint64), none, none, np.zeros(0))))
    langs, tables = pickle.loads(found["model"])
    return Model(langs, tables[0], tables[1:])


def _predict(batches: Iterator[pa.RecordBatch], packed: bytes, at: int) -> Iterator[pa.RecordBatch]:
    langs, words, grams = pickle.loads(packed)
    model, names = Model(langs, words, grams), np.array([*langs, UNKNOWN], object)
    for batch in batches:
        column, lang, score = batch.column(at), [], []
        for _, _, w in _chunks(column):
            k, s = model.predict(w)
            lang += names[k].tolist()
            score += s.tolist()
        yield pa.record_batch([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score (0 to 1) added; they replace columns of the same name.

    Null texts and texts without a letter are ``und`` with score 0; ties go to the language that sorts first; a model of
    no texts calls everything ``und``. A text's other columns are never looked at.
    """
    packed = pickle.dumps((model.langs, model.words, model.grams))
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # of bounded size: most_words and most_grams of each language
    own = docs.drop("lang_pred", "lang_score")
    at = place_of(own, text_col)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    out = own.mapInArrow(lambda it: _predict(it, shared.value, at), f"{spec}, lang_pred string, lang_score double")
    return out


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = train(docs.filter(~held_out), key=F.xxhash64("doc_id"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
