"""Operator 13: compression of vectors to codes of their parts, by cover-tree Lloyd.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook that rounds of Lloyd's
algorithm move. A task builds, for each part position, a cover tree over the vectors of each of its chunks. A node of level i covers
its points within 2**i of its center, its children lie more than 2**(i-1) apart, and it knows the sum of its points. Trees are
written once and read by each round.

A round goes down the trees. If the entry nearest to a center is nearer, by more than the radius of the node twice, than
the second nearest, all points of the node are that entry's (triangle inequality), and their sum is added at once. Other
nodes go down to their children, and the points of leaves are compared exactly, in whole numbers. Tasks give sums
and counts for each entry, which Spark adds up; so a round moves as much as the codebooks hold, however many vectors there are.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.shared import Scratch, free_name, join_counted, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK_VALUES = 1 << 18  # components of the vectors that have trees of their own
LEAF = 8
FANOUT = 256  # children of a node; what would make more goes to the last of them, whose radius says so
PAIRS = 1 << 21  # components compared at a time
LIMB = 10**12
LARGE = 2**63 - 1


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): int64 where all are small, Python's integers where some are not."""
    scaled = np.floor(values.astype(np.float64) * scale) if values.size else np.zeros(values.shape)
    if not values.size or np.abs(scaled).max() < 2.0**40:
        return scaled.astype(np.int64)
    exact = [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in values.astype(np.float64).ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


def _size(points: np.ndarray) -> int:
    return int(np.abs(points).max()) if points.size else 0


def _safe(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if squared distances fit there, else as Python's integers."""
    kind = np.int64 if (_size(points) + _size(book)) ** 2 * max(1, points.shape[-1]) < 2**62 else object
    return points.astype(kind), book.astype(kind)


@dataclass
class Trees:
    """Cover trees of one chunk, one for each part. Points are in such an order that each node's are a range.

    Nodes come level by level: part, start, end (of points), center, radius (to the farthest of its points), total (sum of the
    points), child (first child) and children (their number, 0 for a leaf)."""

    order: np.ndarray
    points: np.ndarray
    part: np.ndarray
    start: np.ndarray
    end: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.float64) - b.astype(np.float64)
    return np.sqrt((d * d).sum(-1))


def cover_trees(parts: np.ndarray) -> Trees:
    """Trees of ``parts``: part positions, vectors, components. All trees and nodes of a level grow together."""
    n_parts, n, width = parts.shape
    points = parts.reshape(n_parts * n, width)
    order = np.arange(len(points))
    part, start, end = np.arange(n_parts), np.arange(n_parts) * n, (np.arange(n_parts) + 1) * n
    levels: list[dict[str, np.ndarray]] = []
    while len(start):
        sizes = end - start
        node = np.repeat(np.arange(len(start)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)  # places of the level's points
        own = points[order[at]]
        far = _apart(own, points[order[start]][node])
        radius = np.maximum.reduceat(far, np.cumsum(sizes) - sizes)
        total = np.add.reduceat(own, np.cumsum(sizes) - sizes, axis=0)
        inner = (sizes > LEAF) & (radius > 0)
        reach = 2.0 ** (np.ceil(np.log2(np.maximum(radius, 1e-300))) - 1)  # what children of this level cover
        label, count = np.zeros(len(at), np.int64), np.zeros(len(start), np.int64)
        left = np.flatnonzero(inner[node])
        while len(left):  # in each node, the first point that none covers becomes a center
            head = np.concatenate(([True], np.diff(node[left]) > 0))
            center = own[left[head]][np.cumsum(head) - 1]
            count[node[left[head]]] += 1
            label[left] = count[node[left]] - 1
            left = left[(_apart(own[left], center) > reach[node[left]]) & (count[node[left]] < FANOUT)]
        moved = np.lexsort((label, node))
        order[at] = order[at[moved]]
        run = np.flatnonzero(np.concatenate(([True], (np.diff(node[moved]) != 0) | (np.diff(label[moved]) != 0))))
        child_start, child_end = at[run], np.concatenate((at[run[1:] - 1], at[-1:])) + 1
        of = node[moved][run]
        kept = inner[of]
        children = np.where(inner, np.bincount(of, minlength=len(start)), 0)
        levels.append({"part": part, "start": start, "end": end, "center": points[order[start]], "radius": radius, "total": total, "children": children})
        part, start, end = part[of[kept]], child_start[kept], child_end[kept]
    joined = {k: np.concatenate([x[k] for x in levels]) for k in levels[0]} if levels else {}
    first = len(levels[0]["part"]) + np.cumsum(joined["children"]) - joined["children"]
    return Trees(order=order % n, points=points[order], child=first, **joined)


def _nearest(points: np.ndarray, part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point: its nearest entry in its part's codebook, the lower one of equals, and the squared distances to it and to the
    second nearest."""
    entries = book.shape[1]
    best = np.zeros(len(points), np.int64)
    one, two = np.zeros(len(points), points.dtype), np.zeros(len(points), points.dtype)
    step = max(1, PAIRS // max(1, entries * points.shape[1]))
    for a in range(0, len(points), step):
        d = points[a : a + step, None, :] - book[part[a : a + step]]
        square, rows = (d * d).sum(-1) if d.shape[-1] else np.zeros(d.shape[:2], points.dtype), np.arange(len(d))
        best[a : a + step] = near = square.argmin(1)
        one[a : a + step] = square[rows, near]
        if entries > 1:
            two[a : a + step] = np.where(np.arange(entries) == near[:, None], square.max(), square).min(1)
    return best, one, two


def assigned(trees: Trees, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, entry, first place, place after the last) of ranges of points that go to one entry; they make up all points."""
    at = np.arange(book.shape[0])  # the roots: the first nodes, one for each part
    points, codes = _safe(trees.points, book)
    center = trees.center.astype(points.dtype)
    only = book.shape[1] == 1
    while len(at):
        best, one, two = _nearest(center[at], trees.part[at], codes)
        near, next_ = np.sqrt(one.astype(np.float64)), np.sqrt(two.astype(np.float64))
        sure = only | (near + 2 * trees.radius[at] < next_ * (1 - 1e-9) - 1e-6)
        yield trees.part[at[sure]], best[sure], trees.start[at[sure]], trees.end[at[sure]]
        at = at[~sure]
        leaf = trees.children[at] == 0
        sizes = (trees.end - trees.start)[at[leaf]]
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(trees.start[at[leaf]], sizes)
        part = np.repeat(trees.part[at[leaf]], sizes)
        yield part, _nearest(points[place], part, codes)[0], place, place + 1
        at = at[~leaf]
        many = trees.children[at]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(trees.child[at], many)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids, labels and trees of every few thousand vectors."""
    for batch in batches:
        vectors = batch.column(2)
        width = len(vectors[0]) if len(vectors) else 0
        step = max(1, CHUNK_VALUES // max(1, width))
        for a in range(0, len(vectors), step):
            part = vectors.slice(a, step)
            values = whole_numbers(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width))
            trees = cover_trees(np.stack(np.split(values, PARTS, axis=1)))
            if trees.points.dtype != object and _size(trees.points) < 2**31:
                trees.points, trees.center, trees.order = trees.points.astype(np.int32), trees.center.astype(np.int32), trees.order.astype(np.int32)
            offsets = pa.array([0, len(part)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(k).slice(a, step)) for k in (0, 1)]
            yield pa.record_batch([*lists, pa.array([pickle.dumps(trees)], pa.binary())], ["ids", "labels", "trees"])


def _sums(batches: Iterator[pa.RecordBatch], book: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, entry, place (of a component; -1: number of points), limb and value: a task's sums, in limbs of 12 decimal digits."""
    parts, entries, width = book.shape
    sums = np.zeros((parts * entries, width + 1), object)
    for batch in batches:
        for packed in batch.column("trees"):
            trees: Trees = pickle.loads(packed.as_py())
            before = np.zeros((len(trees.points) + 1, width), trees.total.dtype)
            np.cumsum(trees.points, axis=0, out=before[1:], dtype=trees.total.dtype)
            own = np.zeros((parts * entries, width + 1), trees.total.dtype)
            for part, entry, a, b in assigned(trees, book):
                np.add.at(own[:, :width], part * entries + entry, before[b] - before[a])
                np.add.at(own[:, width], part * entries + entry, b - a)
            sums += own.astype(object)
    rows = []
    for slot, values in enumerate(sums.tolist()):
        for place, value in enumerate(values):
            sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
            while value:
                rows.append((slot // entries, slot % entries, place if place < width else -1, limb, sign * (value % LIMB)))
                value, limb = value // LIMB, limb + 1
    if rows:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["part", "entry", "place", "limb", "value"])


def _moved(chunks: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after a round. The driver gets one row for each component of an entry."""
    found = chunks.select("trees").mapInArrow(lambda it: _sums(it, book), "part long, entry long, place long, limb long, value long")
    sums: dict[tuple[int, int], dict[int, int]] = {}
    for r in found.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():
        own = sums.setdefault((r["part"], r["entry"]), {})
        own[r["place"]] = own.get(r["place"], 0) + r["value"] * LIMB ** r["limb"]
    out = book.astype(object)
    for (part, entry), own in sums.items():
        out[part, entry] = [own.get(k, 0) // own[-1] for k in range(book.shape[2])]
    return out if _size(out) >= 2**40 else out.astype(np.int64)


def _coded(batches: Iterator[pa.RecordBatch], book: np.ndarray, digits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, labels = (batch.column(k).slice(row, 1).flatten() for k in (0, 1))
            trees: Trees = pickle.loads(batch.column(2)[row].as_py())
            n, parts = len(ids), book.shape[0]
            entry = np.zeros(parts * n, np.int64)
            for _, best, a, b in assigned(trees, book):
                sizes = b - a
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(a, sizes)
                entry[place] = np.repeat(best, sizes)
            points, codes = _safe(trees.points, book)
            away = points - codes[np.repeat(np.arange(parts), n), entry]
            square = (away * away).sum(-1) if away.shape[-1] else np.zeros(len(away), np.int64)
            errors, places = np.zeros(n, object if square.dtype == object or _size(square) > LARGE // (4 * parts) else np.int64), np.zeros((n, parts), np.int64)
            np.add.at(errors, trees.order, square.astype(errors.dtype))
            places[trees.order, np.repeat(np.arange(parts), n)] = entry
            text = ["".join(f"{e:0{digits}x}" for e in own) for own in places.tolist()]
            yield pa.record_batch([ids, labels, pa.array(text, pa.string()), pa.array([min(e, LARGE) for e in errors.tolist()], pa.int64())], ["id", "label", "code", "error"])


def book_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """id, label, code and error of each vector, and the final codebooks (part, entry, component).

    Rows whose vector is null, holds a null or a number that is not finite are dropped, and so are vectors whose length is not that of
    the row of the least id; it is extended by zeros to a multiple of PARTS. The codebooks start from the rows of least id, null
    last, rows of one id by their vectors; fewer rows give fewer entries. Repeated rows are coded each. An error beyond a long is the
    greatest long. An empty table gives an empty result. Other columns are ignored. Memory follows a chunk, not a partition.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    first = rows.select("v", "id").orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    padded = -(-width // PARTS) * PARTS
    rows = rows.filter(F.size("v") == width).withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), padded - width)))
    heads = [r["v"] for r in rows.select("v", "id").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    heads = np.array(heads, np.float64).reshape(len(heads), padded)
    book = np.stack(np.split(whole_numbers(heads), PARTS, axis=1))
    kinds = [vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    chunks = scratch.save(rows.mapInArrow(_chunks, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees binary"))
    for _ in range(rounds if first else 0):
        book = _moved(chunks, book)
    final, digits = book, max(2, len(f"{entries - 1:x}"))
    return chunks.mapInArrow(lambda it: _coded(it, final, digits), f"id {kinds[0]}, label {kinds[1]}, code string, error long"), book


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors summed over rows of one label, null being one; at most the greatest long."""
    scratch, key = Scratch(coded.sparkSession), free_name(coded, "_key")
    rows = scratch.save(coded.withColumn(key, F.struct("label")))  # a struct that holds null equals another one
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGE).cast("decimal(38,0)")).cast("long")
    sums = scratch.save(rows.groupBy(key).agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")), narrow=True)
    return join_counted(rows, sums, key).drop(key)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept."""
    coded, book = compress(table(spark, sf_dir, "embeddings"))
    out = label_errors(coded)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))


def _assign(book: str) -> str:
    """SQL: id, label, part, v, e (nearest entry) and d (squared distance) of every part."""
    apart = "list_sum(list_transform(list_zip(p.v, b.v), z -> (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT vec_id, label, part, any_value(pv) AS v, min(d * 64 + e) % 64 AS e, min(d) AS d FROM (SELECT p.*, p.v AS pv, b.e, CAST({apart} AS BIGINT) AS d FROM parts p JOIN {book} b USING (part)) GROUP BY vec_id, label, part"


def _move(book: str, assigned_to: str) -> str:
    """SQL: part, e, v of the codebooks after a round."""
    each = f"SELECT part, e, i, sum(CAST(v[i] AS BIGINT)) AS s, count(*) AS c FROM {assigned_to}, range(1, (SELECT max(len(v)) + 1 FROM parts)) r(i) GROUP BY part, e, i"
    new = f"SELECT part, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS v FROM ({each}) GROUP BY part, e"
    return f"SELECT b.part, b.e, coalesce(n.v, b.v) AS v FROM {book} b LEFT JOIN ({new}) n USING (part, e)"


ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, x -> CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, part, q[part * len(q) // 16 + 1 : (part + 1) * len(q) // 16] AS v FROM kept, range(16) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_assign("b0")}), b1 AS MATERIALIZED ({_move("b0", "a0")}),
a1 AS MATERIALIZED ({_assign("b1")}), b2 AS MATERIALIZED ({_move("b1", "a1")}),
a2 AS MATERIALIZED ({_assign("b2")}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
FROM coded
"""
