"""Operator 3: toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each category has a logistic regression over the words of the text
(presence of hashed words, scaled by their log odds in training) and over the probabilities of the categories before
it. While training, those probabilities are out of fold, so a later model learns from what an earlier one says of
texts that it has not seen. Training uses a bounded sample of the labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lodeweave.llm.shared import free_name, hash_sample, place_of, table
from lodeweave.llm.textscan import NOT_ALNUM, scans

SAMPLE = 10_000  # labelled rows to train on, at most: those of least hash
FEATURE_BITS = 18
MIN_TEXTS, FOLDS, STEPS, RIDGE = 5, 3, 120, 0.1
THRESHOLD = 0.4


def _features(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, text, feature) of each chunk: the distinct hashed words of each text, those of ``known`` only."""
    for i, j, s in scans(column, lower=True, separators=NOT_ALNUM):
        ids = (s.hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        of = np.repeat(np.arange(j - i), s.counts)
        if known is not None:
            keep = known[ids]
            ids, of = ids[keep], of[keep]
        both = np.unique(of << FEATURE_BITS | ids)
        yield j - i, both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled rows with their features instead of their text."""
    for batch in batches:
        out = []
        for n, of, ids in _features(batch.column("text")):
            out += [x.astype(np.int32) for x in np.split(ids, np.searchsorted(of, np.arange(1, n)))]
        lists = pa.array([x.tolist() for x in out], pa.list_(pa.int32()))
        yield pa.record_batch([batch.column("key"), lists, batch.column("labels")], ["key", "features", "labels"])


class Linear:
    """Logistic regression over sparse 0/1 features, scaled by smoothed log odds, and a few dense ones."""

    def __init__(self, of: np.ndarray, ids: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int):
        n, yes = len(y), float(y.sum())
        seen, hit = np.bincount(ids, minlength=width), np.bincount(ids, y[of], minlength=width)
        self.weights, self.dense = np.zeros(width), np.zeros(dense.shape[1])
        self.bias = float(np.log((yes + 0.5) / (n - yes + 0.5)))
        if not 0 < yes < n:
            return
        odds = np.log((hit + 1) / (yes + 2)) - np.log((seen - hit + 1) / (n - yes + 2))
        scale = np.where(seen >= MIN_TEXTS, odds, 0.0)
        keep = scale[ids] != 0
        of, ids = of[keep], ids[keep]
        values = scale[ids]
        size = np.bincount(of, values**2, n) + (dense**2).sum(1) + 1
        step = 1.0 / (0.25 * np.sqrt(size.max() * size.sum()) + RIDGE)  # a bound of the largest curvature
        w, v = np.zeros(width), np.zeros(dense.shape[1] + 1)
        v[-1] = self.bias
        ahead_w, ahead_v, t = w.copy(), v.copy(), 1.0
        for _ in range(STEPS):  # Nesterov's method
            z = np.bincount(of, values * ahead_w[ids], n) + dense @ ahead_v[:-1] + ahead_v[-1]
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            new_w = ahead_w - step * (np.bincount(ids, values * err[of], width) + RIDGE * ahead_w)
            new_v = ahead_v - step * np.append(dense.T @ err + RIDGE * ahead_v[:-1], err.sum())
            s = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead_w, ahead_v = new_w + (t - 1) / s * (new_w - w), new_v + (t - 1) / s * (new_v - v)
            w, v, t = new_w, new_v, s
        self.weights, self.dense, self.bias = w * scale, v[:-1], float(v[-1])

    def probability(self, of: np.ndarray, ids: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.bincount(of, self.weights[ids], len(dense)) + dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_chain(features: list[np.ndarray], labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(weights, weights of the earlier probabilities, bias) of each category, in order."""
    n, categories = labels.shape
    of = np.repeat(np.arange(n), [len(x) for x in features])
    ids = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    width, fold = 1 << FEATURE_BITS, np.arange(n) % FOLDS
    vocabulary, ids = np.unique(ids, return_inverse=True)
    chain, before = [], np.zeros((n, 0))
    for c in range(categories):
        y = labels[:, c].astype(float)
        m = Linear(of, ids, before, y, max(1, len(vocabulary)))
        whole = np.zeros(width, np.float32)
        whole[vocabulary] = m.weights[: len(vocabulary)]
        chain.append((whole, m.dense, m.bias))
        if c + 1 < categories:
            unseen = np.zeros(n)
            for k in range(FOLDS):
                test, place = fold == k, np.cumsum(fold != k) - 1
                inside = ~test[of]
                part = Linear(place[of[inside]], ids[inside], before[~test], y[~test], max(1, len(vocabulary)))
                unseen[test] = part.probability(of, ids, before)[test]
            before = np.column_stack((before, unseen))
    return chain


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(b.column("key").to_pylist(), b.column("features").to_pylist(), b.column("labels").to_pylist())]
    rows.sort(key=lambda r: (r[0], r[1]))  # whatever order they came in
    chain = train_chain([np.array(r[1], np.int64) for r in rows], np.array([r[2] for r in rows])) if rows else []
    packed = [(np.flatnonzero(w), w[np.flatnonzero(w)], d, b) for w, d, b in chain]
    yield pa.record_batch([pa.array([pickle.dumps(packed)], pa.binary())], ["model"])


def _score(batches: Iterator[pa.RecordBatch], chain: list[tuple[np.ndarray, np.ndarray, float]], categories: int, at: int, name: str) -> Iterator[pa.RecordBatch]:
    known = np.zeros(1 << FEATURE_BITS, bool)
    for w, _, _ in chain:
        known |= w != 0
    for batch in batches:
        column, parts = batch.column(at), []
        for n, of, ids in _features(column, known):
            p = np.full((n, categories), 0.5)
            for c, (w, d, b) in enumerate(chain):
                z = np.bincount(of, w[ids].astype(np.float64), n) + p[:, :c] @ d + b
                p[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            parts.append(p)
        p = np.concatenate(parts) if parts else np.zeros((0, categories))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), categories).cast(pa.list_(pa.float64()))
        yield pa.record_batch([*batch.columns, lists], [*batch.schema.names, name])


def toxicity(
    docs: DataFrame, labelled: DataFrame, categories: dict[str, Column], *, text_col: str = "text", label_text: str = "text", key: Column | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with tox_<category> (probability) for each category and toxic (the last one's is over the threshold) added.

    ``categories``: name -> boolean column of ``labelled``, in the chain's order, the verdict's category last. At most
    ``sample`` rows of ``labelled``, those of least hash of ``key``, train the chain; rows whose labels are null are
    skipped. Without labelled rows all probabilities are 0.5 and nothing is toxic; a category with one class only gets
    its prior. Null and blank texts have no words and get the priors. Added names replace columns of the same name.
    """
    names = list(categories)
    key = F.xxhash64(label_text) if key is None else key
    rows = labelled.select(key.alias("key"), F.col(label_text).alias("text"), F.array(*[c.cast("int") for c in categories.values()]).alias("labels"))
    rows = rows.filter(~F.exists("labels", lambda x: x.isNull()))
    found = hash_sample(rows, F.col("key"), sample).mapInArrow(_collect, "key long, features array<int>, labels array<int>").repartition(1).mapInArrow(_fit, "model binary").first()
    chain = []
    for at, w, d, b in pickle.loads(found["model"]) if found else []:
        whole = np.zeros(1 << FEATURE_BITS, np.float32)
        whole[at] = w
        chain.append((whole, d, b))
    n = len(names)
    own = docs.drop("toxic", *[f"tox_{c}" for c in names])
    at, p = place_of(own, text_col), free_name(own, "_p")
    schema = StructType([*own.schema.fields, StructField(p, ArrayType(DoubleType()))])
    out = own.mapInArrow(lambda it: _score(it, chain, n, at, p), schema)
    out = out.withColumns({f"tox_{c}": F.col(p)[k] for k, c in enumerate(names)}).drop(p)
    return out.withColumn("toxic", (F.col(f"tox_{names[-1]}") > threshold) & F.lit(bool(chain)))


def label_categories() -> dict[str, Column]:
    """The chain over the labels table: low quality first, then toxic."""
    return {"low_quality": F.col("_quality") == 0, "toxic": F.col("_toxic") == 1}


def with_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled documents: _doc, text, _quality, _toxic. A document's repeated labels count once, the worse of them.

    At most ``sample`` labelled ids of ``docs``, those of least hash, are chosen from narrow rows and only then meet
    their texts, broadcast; repeated rows of an id all come along."""
    one = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    ids = hash_sample(one.join(docs.select(F.col("doc_id").alias("_doc")), "_doc", "left_semi"), F.xxhash64("_doc"), sample)
    return docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(ids), "_doc")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, with_labels(docs, table(spark, sf_dir, "labels")), label_categories(), key=F.xxhash64("_doc"))
    return out.select("doc_id", F.round("tox_low_quality", 6).alias("p_low_quality"), F.round("tox_toxic", 6).alias("p_toxic"), "toxic")
