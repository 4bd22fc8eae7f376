"""Operator 1: exact substring deduplication by fixed-block anchors.

Any window of ``window`` words contains a whole aligned block of ``block = (window + 1) // 2`` words. So the
non-overlapping blocks of every document are the index, and every rolling window of ``block`` words probes it:

1. *Anchors.* Groups of documents send the hashes of their rolling windows, with a mark on those that are aligned
   blocks, to buckets; a hash is a hit if it is a block and occurs at least twice.
2. *Extension.* Around each hit the windows of ``window`` words are hashed with 95 bits and exchanged the same
   way; those that occur at least twice are the repeats, and their union is the maximal exact repeats.
3. *Removal.* Words that a repeat covers are cut.

A hash that many documents share reaches its bucket once per group of documents, never once per document, and no
pairs of documents are made. The three steps read one shuffle of the texts, which Spark reuses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import exchange
from lodeweave.llm.shared import Scratch, free_name, located, table, text_volume
from lodeweave.llm.textscan import Scan, scans

WINDOW = 35
GROUP_CHARS, BUCKET_CHARS = 6_000_000, 12_000_000
_KEY_BITS = 30
_OUT = "{id} {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def _anchor_keys(s: Scan, starts: np.ndarray, block: int, buckets: int) -> np.ndarray:
    """Bucket and 30 bits of the hash in one number."""
    h = s.window_hashes(starts, block)
    return ((h >> np.uint64(_KEY_BITS)) % np.uint64(buckets) << np.uint64(_KEY_BITS)) | (h & np.uint64((1 << _KEY_BITS) - 1))


def _long_enough(s: Scan, size: int, window: int) -> np.ndarray:
    """Starts of windows of ``size`` words in texts that have ``window`` words."""
    starts = s.window_starts(size)
    return starts[s.counts[s.text_of(starts)] >= window] if len(starts) else starts


def _probes(t: pa.Table, text: str, window: int, block: int, buckets: int) -> pa.Table:
    if not t.num_rows:
        return exchange.PACKED_ARROW.empty_table()
    keys = []
    for _, _, s in scans(t.column(text)):
        starts = _long_enough(s, block, window)
        if len(starts):
            aligned = (starts - s.word_at[s.text_of(starts)]) % block == 0
            keys.append(_anchor_keys(s, starts, block, buckets) << np.uint64(2) | aligned.astype(np.uint64) << np.uint64(1))
    if not keys:
        return exchange.PACKED_ARROW.empty_table()
    keys = np.sort(np.concatenate(keys))
    bare = keys >> np.uint64(2)
    first = np.flatnonzero(np.concatenate(([True], bare[1:] != bare[:-1])))
    sizes = np.diff(np.append(first, len(bare)))
    block_bit = keys[np.append(first[1:], len(bare)) - 1] & np.uint64(2)  # the last of a run has it if any has
    found = bare[first]
    low = ((found & np.uint64((1 << _KEY_BITS) - 1)) << np.uint64(2) | block_bit | (sizes > 1).astype(np.uint64)).astype(np.uint32)
    return exchange.pack(t.column("g")[0].as_py(), (found >> np.uint64(_KEY_BITS)).astype(np.int64), low)


def _hits(t: pa.Table) -> pa.Table:
    """The hashes of a bucket that are a block of some document and occur twice, for each group that has them."""
    row, low = exchange.unpack(t, np.uint32)
    if not len(low):
        return exchange.PACKED_ARROW.empty_table()
    order = np.argsort(low, kind="stable")
    low, row = low[order], row[order]
    bare = low >> np.uint32(2)
    run = np.cumsum(np.concatenate(([0], (bare[1:] != bare[:-1]).astype(np.int64))))
    n = run[-1] + 1
    block = np.bincount(run, (low & 2) > 0, n) > 0
    twice = np.bincount(run, 1 + (low & 1), n) > 1
    keep = (block & twice)[run]
    return _answer(t, row[keep], bare[keep])


def _answer(t: pa.Table, row: np.ndarray, *cols: np.ndarray) -> pa.Table:
    """The entries again, packed by the group that they came from; one bucket only."""
    if not len(row):
        return exchange.PACKED_ARROW.empty_table()
    g = t.column("g").to_numpy()[row]
    out = exchange.pack(0, g.astype(np.int64), *cols)
    bucket = pa.array(np.full(out.num_rows, t.column("bucket")[0].as_py(), np.int32))
    return pa.table([bucket, out.column("bucket"), out.column("packed")], schema=exchange.PACKED_ARROW)


def _candidate_windows(s: Scan, hits: np.ndarray, window: int, block: int, buckets: int) -> np.ndarray:
    """Starts of the windows of ``window`` words that contain a hit."""
    starts = _long_enough(s, block, window)
    if not len(starts) or not len(hits):
        return np.zeros(0, np.int64)
    keys = _anchor_keys(s, starts, block, buckets)
    at = np.minimum(np.searchsorted(hits, keys), len(hits) - 1)
    hit = starts[hits[at] == keys]
    near = np.zeros(len(s.starts) + 1, np.int32)
    np.add.at(near, np.maximum(hit - (window - block), 0), 1)
    np.add.at(near, hit + 1, -1)
    whole = s.window_starts(window)
    return whole[np.cumsum(near)[whole] > 0]


def _wide(s: Scan, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return s.window_hashes(starts, window), (s.window_hashes(starts, window, second=True) >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)


def _extend(docs: pa.Table, hits: pa.Table, text: str, window: int, block: int, buckets: int) -> pa.Table:
    if not docs.num_rows or not hits.num_rows:
        return exchange.PACKED_ARROW.empty_table()
    row, low = exchange.unpack(hits, np.uint32)
    known = np.sort(hits.column("bucket").to_numpy()[row].astype(np.uint64) << np.uint64(_KEY_BITS) | low.astype(np.uint64))
    high, rest = [], []
    for _, _, s in scans(docs.column(text)):
        starts = _candidate_windows(s, known, window, block, buckets)
        if len(starts):
            a, b = _wide(s, starts, window)
            high.append(a)
            rest.append(b)
    if not high:
        return exchange.PACKED_ARROW.empty_table()
    high, rest = np.concatenate(high), np.concatenate(rest)
    order = np.lexsort((rest, high))
    high, rest = high[order], rest[order]
    first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (rest[1:] != rest[:-1]))))
    sizes = np.diff(np.append(first, len(high)))
    high, rest = high[first], rest[first] | (sizes > 1).astype(np.uint32)
    return exchange.pack(docs.column("g")[0].as_py(), ((high >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), high, rest)


def _repeats(t: pa.Table) -> pa.Table:
    row, high, rest = exchange.unpack(t, np.uint64, np.uint32)
    if not len(high):
        return exchange.PACKED_ARROW.empty_table()
    order = np.lexsort((rest, high))
    row, high, rest = row[order], high[order], rest[order]
    bare = rest & np.uint32(0xFFFFFFFE)
    run = np.cumsum(np.concatenate(([0], ((high[1:] != high[:-1]) | (bare[1:] != bare[:-1])).astype(np.int64))))
    keep = (np.bincount(run, 1 + (rest & 1)) > 1)[run]
    return _answer(t, row[keep], high[keep], bare[keep])


def _cut(docs: pa.Table, repeats: pa.Table, text: str, window: int, schema: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    _, high, rest = exchange.unpack(repeats, np.uint64, np.uint32)
    order = np.lexsort((rest, high))
    high, rest = high[order], rest[order]
    n_words, n_removed, spans, kept = [], [], [], []
    for _, _, s in scans(docs.column(text)):
        cover = np.zeros(len(s.starts) + 1, np.int64)
        whole = s.window_starts(window) if len(high) else np.zeros(0, np.int64)
        if len(whole):
            a, b = _wide(s, whole, window)
            at = np.searchsorted(high, a)
            same = np.zeros(len(a), bool)
            for step in range(2):  # two different windows with one 64-bit hash would be neighbours
                k = np.minimum(at + step, len(high) - 1)
                same |= (high[k] == a) & (rest[k] == b)
            np.add.at(cover, whole[same], 1)
            np.add.at(cover, whole[same] + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        sums = np.concatenate(([0], np.cumsum(gone)))
        for i in range(len(s.counts)):
            a, b = int(s.word_at[i]), int(s.word_at[i + 1])
            cut = int(sums[b] - sums[a])
            n_words.append(b - a)
            n_removed.append(cut)
            own = s.raw[s.offsets[i] : s.offsets[i + 1]].tobytes().split()
            if cut:
                mask = np.concatenate(([False], gone[a:b], [False])).astype(np.int8)
                edges = np.flatnonzero(np.diff(mask))
                spans.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
                own = [w for w, g in zip(own, gone[a:b].tolist()) if not g]
            else:
                spans.append([])
            kept.append(b" ".join(own).decode())
    return pa.table([docs.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, schema.field(3).type), pa.array(kept, pa.string())], schema=schema)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, groups: int | None = None, stored: bool = False) -> DataFrame:
    """Cut every word that lies in a window of ``window`` words whose words also start elsewhere.

    Returns one row for each row of ``docs``: the id, n_words, n_removed, removed (spans of word numbers, end
    exclusive: the maximal exact repeats) and kept_text (the other words, joined by one space). Null and blank texts
    have no words; texts shorter than the window keep all. Repeated rows and equal texts count as occurrences of each
    other, so both are cut whole. Other columns of ``docs`` are ignored; an empty table gives an empty result. Rows are
    dealt to groups by their place in the table, so neither repeated rows nor ids that are null or equal gather in one
    group. Words are compared by hash: 95 bits decide. ``stored`` is that of ``located``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if window < 2:
        raise ValueError("window must be at least 2 words")
    block = (window + 1) // 2
    scratch, at = Scratch(docs.sparkSession), free_name(docs, "_at")
    docs = located(scratch, docs.select(id_col, text_col), at, stored=stored)
    volume = text_volume(docs, text_col) if groups is None else 0
    # A group holds a few MB of texts. A bucket holds the hashes of as much again, whatever the number of groups is.
    buckets = groups or max(8, -(-volume // BUCKET_CHARS))
    groups = groups or max(8, -(-volume // GROUP_CHARS))
    spec = _OUT.format(id=f"`{id_col}`", kind=docs.schema[id_col].dataType.simpleString())
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], spec).schema)
    rows = docs.select(F.col(id_col), F.col(text_col), F.pmod(F.xxhash64(at), F.lit(groups)).cast("int").alias("g"))
    by_group = rows.groupBy("g")
    hits = by_group.applyInArrow(lambda t: _probes(t, text_col, window, block, buckets), exchange.PACKED).groupBy("bucket").applyInArrow(_hits, exchange.PACKED)
    windows = by_group.cogroup(hits.groupBy("g")).applyInArrow(lambda d, h: _extend(d, h, text_col, window, block, buckets), exchange.PACKED)
    repeats = windows.groupBy("bucket").applyInArrow(_repeats, exchange.PACKED)
    return by_group.cogroup(repeats.groupBy("g")).applyInArrow(lambda d, r: _cut(d, r, text_col, window, schema), spec)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and n_spans of every document."""
    out = dedup_substrings(table(spark, sf_dir, "documents"), stored=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_spans"))
