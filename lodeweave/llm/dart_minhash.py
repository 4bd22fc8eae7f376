"""Operator 7: near-duplicate classes by DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles; similarity is weighted Jaccard over the counts.

*Signatures.* Each unit of weight of a shingle is a region with a Poisson process of darts along the rank axis,
drawn from a generator that the region seeds, so equal regions get equal darts in every document. A dart has a
rank and a coordinate; a document keeps the earliest dart of each coordinate. Darts are thrown up to a rank that
yields about ``k ln k`` of them whatever the number of shingles, and further where a coordinate is still empty.

*Joining.* Texts with equal words are one node. Coordinates make bands; nodes that share a band are candidates.
Each shared band tests its members against one pivot only, never against each other. Members that stay apart are
tested against further pivots, then exactly. In small bands these are the pairs of different components whose
distances to the first pivot allow a link (1 - weighted Jaccard is a metric). In large ones, blocks of texts are
compared by products of sparse matrices, and a block returns a forest of links, so pairs are never rows. So no link
among the candidates is lost, while tight groups of any size cost one test a member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.shared import Scratch, free_name, join_counted, located, table
from lodeweave.llm.textscan import CHUNK_BYTES, Scan, buffers, mix, scans

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability 3e-6
_GOLD = np.uint64(0x9E3779B97F4A7C15)
PIVOTS = 4
SALT_ROWS = 256
SMALL_BAND = 32  # members still apart of a band whose pairs are listed; those of larger bands are compared in blocks
BLOCK_TEXTS, BLOCK_WORDS, COLUMNS = 512, 200_000, 4096


def shingles(s: Scan, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text of fewer words, but not none, is one shingle."""
    starts = s.window_starts(size)
    hashes, of = s.window_hashes(starts, size), s.text_of(starts)
    for n in range(1, size):
        short = np.flatnonzero(s.counts == n)
        if len(short):
            hashes = np.concatenate((hashes, s.window_hashes(s.word_at[short], n)))
            of = np.concatenate((of, short))
    return of, hashes


def unit_regions(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One region for each unit of weight: copy j of a shingle in a text has the shingle's j-th region."""
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    first = np.concatenate(([True], (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])))
    run = np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    return of, mix(hashes + (np.arange(len(of)) - run).astype(np.uint64) * _GOLD)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(of: np.ndarray, regions: np.ndarray, texts: int, k: int) -> np.ndarray:
    """k values for each text: the id of the earliest dart of each coordinate (0 for a text without regions)."""
    weight = np.bincount(of, minlength=texts)
    limit = np.zeros(texts)
    np.divide(k * (np.log(k) + 2), weight, out=limit, where=weight > 0)
    rank, winner = np.full(texts * k, np.inf), np.zeros(texts * k, np.uint64)
    state, at = regions.copy(), np.zeros(len(regions))
    live = np.arange(len(regions))
    state = mix(state + _GOLD)
    at = -np.log(_uniform(state))  # rank of each region's first dart
    while True:
        turn = live[at[live] <= limit[of[live]]]
        while len(turn):
            dart = mix(state[turn] ^ np.uint64(0x5851F42D4C957F2D))
            slot = of[turn] * k + (dart % np.uint64(k)).astype(np.int64)
            best = np.full(len(rank), np.inf) if len(turn) > len(rank) // 8 else None
            if best is None:
                order = np.lexsort((at[turn], slot))
                head = order[np.concatenate(([True], np.diff(slot[order]) > 0))]
            else:
                np.minimum.at(best, slot, at[turn])
                head = np.flatnonzero(at[turn] == best[slot])
            won = head[at[turn][head] < rank[slot[head]]]
            rank[slot[won]], winner[slot[won]] = at[turn][won], dart[won]
            state[turn] = mix(state[turn] + _GOLD)
            at[turn] -= np.log(_uniform(state[turn]))
            turn = turn[at[turn] <= limit[of[turn]]]
        poor = np.isinf(rank.reshape(texts, k)).any(1) & (weight > 0)
        if not poor.any():
            return winner.reshape(texts, k)
        limit[poor] *= 2
        live = np.flatnonzero(poor[of])


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.shape[1] // bands
    out = np.zeros((len(signatures), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * _GOLD + signatures[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def content_keys(s: Scan) -> list[bytes]:
    """16 bytes for each text: equal for texts with equal words in equal order."""
    return [hashlib.md5(b" ".join(s.raw[a:b].tobytes().split())).digest() for a, b in zip(s.offsets[:-1], s.offsets[1:])]


def _sign(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, s in scans(batch.column(2)):
            of, regions = unit_regions(*shingles(s, size))
            keys = band_keys(dart_signatures(of, regions, j - i, bands * rows), bands)
            offsets = pa.array(np.arange(j - i + 1, dtype=np.int32) * bands)
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            yield pa.record_batch(
                [*(batch.column(k).slice(i, j - i) for k in range(2)), pa.array(content_keys(s), pa.binary()), pa.array(s.counts.astype(np.int64)), lists], ["id", "at", "content", "n_words", "bands"]
            )


def signatures(docs: DataFrame, at: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, at (the place of the row, see ``located``), content (a key of the words), n_words and bands (a hash for each band)
    of each row of ``docs``."""
    kinds = ", ".join(f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in (("id", id_col), ("at", at)))
    return docs.select(F.col(id_col).alias("id"), F.col(at).alias("at"), F.col(text_col).alias("text")).mapInArrow(
        lambda it: _sign(it, shingle, bands, rows), f"{kinds}, content binary, n_words long, bands array<long>"
    )


def _slices(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about CHUNK_BYTES of text: a row or more each."""
    ends = np.cumsum(sum(np.diff(buffers(batch.column(c))[1]) for c in columns))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _similarities(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """a, b, distance of each row (a, b, text_a, text_b)."""
    for batch in (x for b in batches for x in _slices(b, ("text_a", "text_b"))):
        sides = []
        for c in ("text_a", "text_b"):
            own = []
            for i, j, s in scans(batch.column(c)):
                of, regions = unit_regions(*shingles(s, size))
                own += np.split(regions, np.searchsorted(of, np.arange(1, j - i)))
            sides.append(own)
        distance = []
        for x, y in zip(*sides):
            both = len(np.intersect1d(x, y, assume_unique=True))
            distance.append(1.0 - both / max(1, len(x) + len(y) - both))
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(distance, pa.float64())], ["a", "b", "d"])


def _verified(scratch: Scratch, pairs: DataFrame, places: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """a, b, d for each of the distinct ``pairs`` (a, b), a written table of node numbers. ``places``: node, at; ``texts``: at, text.

    b may be in many pairs: its text is copied to one place for each SALT_ROWS of them, so that no task gets all pairs
    of a pivot."""
    uses = scratch.save(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.floor(F.col("n") / SALT_ROWS) + 1), narrow=True)
    salted = join_counted(pairs, uses, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts"))).drop("salts")
    a = salted.join(places.withColumnRenamed("node", "a"), "a").join(texts.withColumnRenamed("text", "text_a"), "at").drop("at")
    b = uses.drop("n").join(places.withColumnRenamed("node", "b"), "b").join(texts.withColumnRenamed("text", "text_b"), "at").drop("at")
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    both = a.join(b, ["b", "salt"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda it: _similarities(it, size), "a long, b long, d double")


def _shared_weights(of: np.ndarray, regions: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Regions that text left[i] and text right[j] share: a product of matrices, built for COLUMNS regions at a time."""
    order = np.argsort(regions, kind="stable")
    of, regions = of[order], regions[order]
    column = np.cumsum(np.diff(regions, prepend=regions[:1]) != 0)
    often = np.bincount(column) > 1  # a region of one text adds nothing
    keep = often[column]
    of, column = of[keep], (np.cumsum(often) - 1)[column[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, total + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = np.zeros((n, COLUMNS), np.float32)
        part[of[a:b], column[a:b] - k * COLUMNS] = 1
        out += part[left] @ part[right].T
    return out


def _linked_labels(block: pa.Table, size: int, limit: float) -> pa.Table:
    """a, b: links between the labels of a block's texts, as a spanning forest: no more rows than texts."""
    i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
    of, regions = [], []
    for at, _, s in scans(block.column("text")):
        o, r = unit_regions(*shingles(s, size))
        of.append(o + at)
        regions.append(r)
    whose, n = np.concatenate(of), block.num_rows
    weight = np.bincount(whose, minlength=n)
    own = block.column("own").to_numpy()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    coded = block.column("label").combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy()
    both = _shared_weights(whose, np.concatenate(regions), n, left, right)
    distance = 1.0 - both / np.maximum(1, weight[left][:, None] + weight[right][None] - both.astype(np.float64))
    x, y = np.nonzero((distance <= limit) & (code[left][:, None] != code[right][None]))
    x, y, root = code[left[x]], code[right[y]], np.arange(len(coded.dictionary))
    while True:
        low = np.minimum(root[x], root[y])
        if (root[x] == low).all() and (root[y] == low).all():
            break
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": coded.dictionary.take(pa.array(moved)), "b": coded.dictionary.take(pa.array(root[moved]))})


def _block_links(scratch: Scratch, members: DataFrame, places: DataFrame, texts: DataFrame, size: int, limit: float) -> DataFrame:
    """Links (a, b) between labels of the ``members`` (band, node, label, home) of large bands, each block of texts against
    each other block. Members with the band's most frequent label are linked already: their blocks meet the blocks of
    the others only. Blocks have a bound of texts and words, so a task's memory does not grow with the band, and what a
    block returns is a forest, not its pairs. ``places``: node, at, n_words; ``texts``: at, text."""
    own = scratch.save(members.select("band", "node", "label", (F.col("label") == F.col("home")).alias("at_home")).join(places, "node"), narrow=True)
    parts = own.groupBy("band").agg(
        *[
            F.ceil(F.greatest(F.count_if(c) / BLOCK_TEXTS, F.sum(F.when(c, F.col("n_words")).otherwise(0)) / BLOCK_WORDS)).cast("int").alias(name)
            for name, c in (("others", ~F.col("at_home")), ("homes", F.col("at_home")))
        ],
        F.count(F.lit(1)).alias("n"),
    )
    own = join_counted(own, scratch.save(parts, narrow=True), "band")
    hashed = F.xxhash64("node", F.lit("block"))
    own = own.withColumn("own", F.when(F.col("at_home"), F.col("others") + F.pmod(hashed, F.col("homes"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int"))
    other = F.sequence(F.lit(0), F.when(F.col("at_home"), F.col("others")).otherwise(F.col("others") + F.col("homes")) - 1)
    meet = own.withColumn("other", F.explode(other)).select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "at", "label")
    return meet.join(texts, "at").drop("at").groupBy("band", "i", "j").applyInArrow(lambda t: _linked_labels(t, size, limit), "a long, b long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of ``edges`` (a, b). Labels spread to neighbours and jump to
    their label's label, so long chains take few rounds."""
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), narrow=True)
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), narrow=True)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        step = labels.join(near, "node").join(hop, "label")
        new = scratch.save(step.select("node", F.least("label", "near", "jump").alias("label"), (F.least("near", "jump") < F.col("label")).alias("moved")), narrow=True)
        moved = new.filter("moved").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            scratch.drop(both)
            return labels.select("node", "label")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    exact_after: int = 4,
    stored: bool = False,
) -> DataFrame:
    """Class of near-duplicates of each row of ``docs``: the id, n_words, class_id, kept, and at, the row's place (see ``located``).

    Documents of a class are connected by links of at least ``similarity``; class_id is the least id of the class and
    kept is true for one row of the class, the first by place of those with that id. Texts whose words are equal are of one
    class; different texts of one id are different documents. A text without words, a null text and a row without an
    id are linked to nothing: class_id is the row's own id, kept is true. Other columns of ``docs`` are ignored; an empty
    table gives an empty result. ``exact_after``: while the pairs left open are more than so many times the bands'
    members, further pivots are tried first; it sets the order of the work and not its result.
    """
    scratch = Scratch(docs.sparkSession)
    place = free_name(docs, "_at")
    docs = located(scratch, docs, place, stored=stored)
    texts = docs.select(F.col(place).alias("at"), F.col(text_col).alias("text"))
    signed = scratch.save(signatures(docs, place, id_col, text_col, shingle, bands, rows))
    linkable = signed.filter((F.col("n_words") > 0) & F.col("id").isNotNull())
    # Rows with equal words are one node, the number of which is fixed by writing it.
    content = linkable.groupBy("content").agg(F.min(F.struct("id", "at")).alias("head"), F.first("bands").alias("bands"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n"))
    nodes = scratch.save(content.withColumn("node", F.monotonically_increasing_id()))
    places = nodes.select("node", F.col("head.at").alias("at"))
    # A band's members, where it has two: its first pivot is the least node, found by partial sums, not by gathering.
    member = nodes.select("node", F.explode(F.array_distinct("bands")).alias("band"))
    shared = scratch.save(member.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), narrow=True)
    member = scratch.save(join_counted(member, shared, "band"), narrow=True)
    limit = 1.0 - similarity + 1e-9

    pairs = scratch.save(member.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), narrow=True)
    tested = scratch.save(_verified(scratch, pairs, places, texts, shingle), narrow=True)
    label = components(scratch, tested.filter(F.col("d") <= limit))
    # Distances to the first pivot of each band, for the triangle bound; the pivot's own is 0.
    known = tested.withColumnsRenamed({"a": "node", "b": "first"})
    placed = member.join(known, ["node", "first"], "left").withColumn("d", F.when(F.col("node") == F.col("first"), 0.0).otherwise(F.coalesce("d", F.lit(1.0))))
    placed = scratch.save(placed, narrow=True)
    scratch.drop(pairs, shared, member)
    tests = tested.select("a", "b")

    def open_bands() -> tuple[DataFrame, int, int]:
        """Members, with labels, of the bands where two components besides the pivot are left; how many pairs and members.
        ``many`` says whether a band has more than SMALL_BAND of them, ``home`` is its most frequent label."""
        named = placed.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = named.groupBy("band", "label").agg(F.count_if(F.col("d") > 0).alias("n"))
        left = sizes.groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label"))["label"].alias("home"))
        left = left.filter("labels > 1 and n > 1").select("band", "home", (F.col("n") > SMALL_BAND).alias("many"), "n", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs"))
        left = scratch.save(left.filter("pairs > 0"), narrow=True)
        total = left.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        if not total["p"]:
            return left, 0, 0
        members = join_counted(placed.filter("d > 0"), left.drop("pairs"), "band").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return scratch.save(members, narrow=True), int(total["p"]), int(total["n"])

    def merge(links: DataFrame) -> None:
        """Join the components whose labels are linked (a, b)."""
        nonlocal label
        new = scratch.save(links.filter("a <> b").distinct(), narrow=True)
        if new.limit(1).count():
            moved = components(scratch, new)
            whole = label.unionByName(moved.select(F.col("node"), F.col("node").alias("label")).join(label.select("node"), "node", "left_anti"))
            label = scratch.save(whole.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), narrow=True)
        scratch.drop(new)

    def tested_links(found: DataFrame) -> DataFrame:
        """Links between labels of those pairs (x, y) that were not tested before."""
        nonlocal tests
        fresh = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old = tests.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = scratch.save(fresh.join(old, ["a", "b"], "left_anti"), narrow=True)
        got = scratch.save(_verified(scratch, fresh, places, texts, shingle), narrow=True)
        tests = tests.unionByName(got.select("a", "b"))
        of = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
        new = got.filter(F.col("d") <= limit).join(of("a"), "a", "left").join(of("b"), "b", "left")
        return new.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))

    apart = (F.col("label_x") != F.col("label_y")) & (F.abs(F.col("dx") - F.col("dy")) <= limit)  # a link is possible
    x_side, y_side = ({"node": side, "label": f"label_{side}", "d": f"d{side}"} for side in ("x", "y"))
    still, n_pairs, n_members = open_bands()
    for turn in range(1, PIVOTS):
        if n_pairs <= exact_after * n_members:
            break
        before, large = n_pairs, still.filter("many")
        pivot = large.groupBy("band").agg(F.min_by(F.struct("node", "label", "d"), F.xxhash64("node", F.lit(turn))).alias("p"), F.count(F.lit(1)).alias("n"))
        pivot = scratch.save(pivot.select("band", "n", "p.*").withColumnsRenamed(y_side), narrow=True)
        merge(tested_links(join_counted(large.select("band", *x_side).withColumnsRenamed(x_side), pivot, "band").filter(apart).select("x", "y")))
        still, n_pairs, n_members = open_bands()
        if n_pairs > 0.75 * before:
            break  # these are apart, and further pivots would not bring them together
    if n_pairs:
        small = still.filter("not many").select("band", *x_side)
        met = small.withColumnsRenamed(x_side).join(small.withColumnsRenamed(y_side), "band").filter(apart & (F.col("x") < F.col("y")))
        blocks = _block_links(scratch, still.filter("many"), nodes.select("node", F.col("head.at").alias("at"), "n_words"), texts, shingle, limit)
        merge(tested_links(met.select("x", "y")).unionByName(blocks))
    linked = label.join(nodes.select("node", "head"), "node")
    tops = scratch.save(linked.groupBy("label").agg(F.min("head").alias("top"), F.count(F.lit(1)).alias("n")), narrow=True)
    of_node = join_counted(linked.select("node", "label"), tops, "label").select("node", "top")
    of_content = scratch.save(nodes.join(of_node, "node", "left").select("content", F.coalesce("top", "head").alias("top"), "n"))
    scratch.drop(nodes, tested, placed, tops)
    found = join_counted(linkable, of_content, "content")
    found = found.select("id", "n_words", F.col("top.id").alias("class_id"), (F.col("at") == F.col("top.at")).alias("kept"), "at")
    alone = signed.filter((F.col("n_words") == 0) | F.col("id").isNull()).select("id", "n_words", F.col("id").alias("class_id"), F.lit(True).alias("kept"), "at")
    return found.unionByName(alone).select(F.col("id").alias(id_col), "n_words", "class_id", "kept", "at")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """One row of each class of near-duplicates, with all columns of ``docs``: that which ``near_duplicates`` keeps. Rows without an id
    or without words stay, and so does each text of an id with several."""
    scratch, place = Scratch(docs.sparkSession), free_name(docs, "_at")
    docs = located(scratch, docs, place, stored=stored)
    gone = near_duplicates(docs.drop(place), id_col=id_col, text_col=text_col, stored=True).filter(~F.col("kept")).select(F.col("at").alias(place))
    return docs.join(gone, place, "left_anti").drop(place)


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, class_id (least id of the class of near-duplicates) and kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), stored=True).drop("at")
