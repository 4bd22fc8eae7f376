"""Operator 11: near-duplicate components by SimHash and deletion-variant signatures.

A fingerprint has a bit for each of 64 places: 1 if over half of the hashes of a text's shingles have it. Fingerprints
link at ``distance`` or fewer differing bits. Cut into distance // 2 + 1 segments, two that link have a segment in which
they differ in at most one bit. So each segment is indexed under every variant of it that leaves out one bit; fingerprints
that share a variant are candidates, and each candidate is verified over all 64 bits.

Equal fingerprints are one node, so copies of a text cost nothing. The nodes of a variant come ordered by variant through a
task, which compares them by array operations and gives a forest of the links that it finds, never their pairs. A variant
of very many nodes is cut into blocks that meet block by block. Most of such nodes differ from another one by a single bit:
these links are found first, by the variants of the whole fingerprint, which two nodes at most share. Then nodes of the
variant's most frequent component are not compared with each other any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.dart_minhash import components
from lodeweave.llm.shared import Scratch, join_counted, lookup, table

SHINGLE, DISTANCE, BITS, SEED = 4, 4, 64, 42
PIECE = 1 << 20  # bytes of a text that are read at a time
HASHES = 1 << 16
BLOCK = 2048  # nodes of a variant that are compared in one place; more are cut into blocks
PAIRS = 1 << 19


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece; a piece ends where white space is."""
    at = 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and text[to] not in b" \t\n\x0b\f\r":
            to += 1
        yield text[at:to].split()  # bytes are split at ASCII white space only
        at = to


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text; shingles repeat as often as they occur."""
    ones, total, carried = np.zeros(BITS, np.int64), 0, []

    def count(hashes: list[int]) -> None:
        for a in range(0, len(hashes), HASHES):
            part = np.array(hashes[a : a + HASHES], "<u8")
            ones[:] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)

    for words in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):  # bytes: A-Z only
        words = carried + words
        if len(words) < shingle:
            carried = words
            continue
        joined = b" ".join(words)
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
        n = len(words) - shingle + 1
        count([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (starts[shingle:] - 1).tolist())])
        total, carried = total + n, words[n:]
    if not total and carried:
        count([xxhash.xxh64_intdigest(b" ".join(carried), SEED)])
        total = 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _signed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (as a long) of each row. A text without words has 0, one of fewer words than a shingle is one shingle."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _signed(it, shingle), f"id {kind}, fp long")


def _masks(segments: int) -> list[list[int]]:
    """For each segment, its bits without one, for each of them."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    return [[sum(1 << b for b in range(lo, hi) if b != out) for out in range(lo, hi)] for lo, hi in zip(cuts, cuts[1:])]


def _kept(fp: Column, mask: int) -> Column:
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _variants(fp: Column, segments: int) -> Column:
    """Array of (place, rest): the segment of each place without the bit there. A place belongs to one segment."""
    masks = [m for own in _masks(segments) for m in own]
    return F.array(*[F.struct(F.lit(place).alias("place"), _kept(fp, m).alias("rest")) for place, m in enumerate(masks)])


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of ``n`` members' component, of links x, y."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        if (root[x] == low).all() and (root[y] == low).all():
            return root
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]


def _links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """a, b: links of whole groups of rows (ordered by group) as a forest. Rows of sides 0 and 1 are compared across, rows of side 2
    with each other."""
    starts = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
    ends = np.append(starts[1:], len(group))
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.bitwise_count(fp[x] ^ fp[y]) <= distance
        ok &= (side[x] == 2) | (side[x] != side[y])
        return x[ok], y[ok]

    small = np.repeat(ends - starts <= 64, ends - starts)
    last = np.repeat(ends, ends - starts)
    at = np.flatnonzero(small)
    for gap in range(1, 64):
        at = at[at + gap < last[at]]
        if not len(at):
            break
        x, y = near(at, at + gap)
        xs.append(x)
        ys.append(y)
    for a, b in zip(starts, ends):
        if b - a > 64:
            root = np.arange(b - a)  # the group's links as a forest at once
            step = max(1, PAIRS // (b - a))
            for i in range(a, b, step):
                x, y = np.divmod(np.arange((min(b, i + step) - i) * (b - i)), b - i)
                x, y = near((x + i)[y > x], (y + i)[y > x])
                known = np.flatnonzero(root != np.arange(b - a))
                root = _forest(np.concatenate((x - a, known)), np.concatenate((y - a, root[known])), b - a)
            known = np.flatnonzero(root != np.arange(b - a))
            xs.append(a + known)
            ys.append(a + root[known])
    root = _forest(np.concatenate(xs), np.concatenate(ys), len(group))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return fp[moved].view(np.int64), fp[root[moved]].view(np.int64)


def _compared(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (place, rest, i, j, side, fp): a group may go on in the next batch, so its rows wait for it."""
    waiting: list[pa.RecordBatch] = []

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [table.column(k).to_numpy() for k in range(6)]
        new = np.zeros(len(table), bool)
        for c in columns[:4]:
            new[1:] |= np.diff(c) != 0
        a, b = _links(np.cumsum(new), columns[4], columns[5].view(np.uint64), distance)
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in range(4))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns, last = [batch.column(k).to_numpy() for k in range(4)], key(batch, -1)
        differs = np.flatnonzero(np.logical_or.reduce([c != v for c, v in zip(columns, last)]))
        cut = int(differs[-1]) + 1 if len(differs) else 0  # the last group starts here
        if cut:
            yield from found(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        elif waiting and key(waiting[-1], -1) != last:
            yield from found(pa.Table.from_batches(waiting))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield from found(pa.Table.from_batches(waiting))


def _meet(rows: DataFrame, distance: int) -> DataFrame:
    """a, b: links of rows (place, rest, i, j, side, fp) among those that share the first four columns."""
    keys = ["place", "rest", "i", "j"]
    rows = rows.select(*keys, "side", "fp").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(lambda it: _compared(it, distance), "a long, b long").distinct()


def _one_bit(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """a, b: links between ``nodes`` (fp) that differ in one bit: a variant of a whole fingerprint has two nodes at most."""
    shared = nodes.select("fp", F.explode(_variants(F.col("fp"), 1)).alias("v")).groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    return scratch.save(shared.filter("a <> b").select("a", "b"), narrow=True)


def _crowded(scratch: Scratch, nodes: DataFrame, member: DataFrame, segments: int, block: int) -> DataFrame | None:
    """v, n: variants of more than ``block`` nodes, None if there are none. Such a variant is of a segment's value that over half as many
    nodes have, so values are counted, which are far fewer than variants, and only their variants after them."""
    whole = F.array(*[F.struct(F.lit(k).alias("segment"), _kept(F.col("fp"), own[0] | own[-1]).alias("value")) for k, own in enumerate(_masks(segments))])
    values = nodes.select(F.explode(whole).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block // 2)
    values = scratch.save(values, narrow=True)
    if not values.limit(1).count():
        return None
    first = 0
    of_value = []
    for k, own in enumerate(_masks(segments)):
        each = F.array(*[F.struct(F.lit(first + i).alias("place"), _kept(F.col("s.value"), m).alias("rest")) for i, m in enumerate(own)])
        of_value.append(F.when(F.col("s.segment") == k, each))
        first += len(own)
    may = scratch.save(values.select(F.explode(F.coalesce(*of_value)).alias("v")).distinct(), narrow=True)
    large = member.join(lookup(may), "v").groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = scratch.save(large, narrow=True)
    return large if large.limit(1).count() else None


def links(scratch: Scratch, nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints (``nodes``, a written table: fp) that connect what is connected at ``distance`` or
    fewer bits."""
    segments = distance // 2 + 1
    member = nodes.select("fp", F.explode(_variants(F.col("fp"), segments)).alias("v"))
    large = _crowded(scratch, nodes, member, segments, block)
    few = member if large is None else member.join(lookup(large.select("v")), "v", "left_anti")
    whole = few.select("v.place", "v.rest", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "fp")
    if large is None:
        return scratch.save(_meet(whole, distance), narrow=True)
    # Variants of very many nodes: blocks of what single bits leave apart meet each other and the blocks of the largest component.
    crowded = scratch.save(join_counted(member, large, "v"), narrow=True)
    single = _one_bit(scratch, crowded.select("fp").distinct())
    label = components(scratch, single).withColumnsRenamed({"node": "fp"})
    named = scratch.save(crowded.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), narrow=True)
    home = named.groupBy("v", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("v").agg(F.max(F.struct("n", "label")).alias("home"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / (block // 2)).cast("int")
    home = scratch.save(home.select("v", "n", F.col("home.label").alias("home"), blocks(F.col("home.n")).alias("homes"), blocks(F.col("n") - F.col("home.n")).alias("others")), narrow=True)
    own = join_counted(named, home, "v").withColumn("in_home", F.col("label") == F.col("home"))
    hashed = F.xxhash64("fp")
    own = own.withColumn("own", F.when(F.col("in_home"), F.col("others") + F.pmod(hashed, F.greatest("homes", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("others", F.lit(1)))).cast("int"))
    other = F.sequence(F.lit(0), F.when(F.col("in_home"), F.col("others")).otherwise(F.col("others") + F.col("homes")) - 1)
    met = own.filter(~F.col("in_home") | (F.col("others") > 0)).withColumn("other", F.explode(other))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("v.place", "v.rest", i.alias("i"), j.alias("j"), F.when(i == j, 2).when(F.col("own") == i, 0).otherwise(1).alias("side"), "fp")
    found = scratch.save(_meet(whole.unionByName(met), distance).unionByName(single), narrow=True)
    scratch.drop(crowded, named, home)
    return found


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """id, fp (fingerprint as a long), component_id: the least id of all rows whose fingerprints are connected by links of
    ``distance`` or fewer bits, for each row of ``docs``.

    Null and blank texts have fingerprint 0, which is linked like any other. A null id is no least id: a component of such rows
    alone has a null component_id. Rows of one id are rows of their own; repeated rows are alike. Other columns are ignored, an
    empty table gives an empty result. Texts are read whole, piece by piece.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.save(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = scratch.save(signed.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), narrow=True)
    label = components(scratch, links(scratch, nodes.select("fp"), distance, block))
    linked = scratch.save(nodes.join(label.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("label", F.coalesce("label", "fp")), narrow=True)
    least = scratch.save(linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), narrow=True)
    of_node = scratch.save(join_counted(linked.select("fp", "label", F.col("n").alias("rows")), least, "label").select("fp", "component_id", F.col("rows").alias("n")), narrow=True)
    return join_counted(signed, of_node, "fp").select("id", "fp", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
