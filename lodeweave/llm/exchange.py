"""Compact exchange of hashes between groups of documents.

A group of documents (a few MB of text) sends each distinct hash once, packed into one binary value for each
(bucket, group) pair; the reducer of a bucket sees in how many groups a hash occurs and answers each group with
the hashes that passed. However many documents hold a hash, a bucket gets it once per group, so no key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PACKED = "bucket int, g int, packed binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("packed", pa.binary())])


def _records(kinds: tuple[np.dtype, ...]) -> np.dtype:
    return np.dtype([(f"c{k}", kind) for k, kind in enumerate(kinds)])


def pack(g: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row for each bucket that occurs; a packed value holds the records of ``columns``, one after the other."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    records = np.empty(len(bucket), _records(tuple(c.dtype for c in columns)))
    for k, c in enumerate(columns):
        records[f"c{k}"] = c[order]
    offsets = (np.append(cuts, len(bucket)) * records.itemsize).astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(records.tobytes())])
    return pa.table([pa.array(bucket[cuts].astype(np.int32)), pa.array(np.full(len(cuts), g, np.int32)), values], schema=PACKED_ARROW)


def unpack(table: pa.Table, *kinds: type) -> tuple[np.ndarray, ...]:
    """Row number of each entry, then the columns that pack() stored: read from Arrow's buffers, however many rows there are."""
    kind = _records(tuple(np.dtype(k) for k in kinds))
    counts, parts = [np.zeros(0, np.int64)], [np.zeros(0, kind)]
    for chunk in table.column("packed").chunks:
        if len(chunk):
            _, off, data = chunk.buffers()
            offsets = np.frombuffer(off, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            counts.append(np.diff(offsets).astype(np.int64) // kind.itemsize)
            parts.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind))
    records, counts = np.concatenate(parts), np.concatenate(counts)
    return (np.repeat(np.arange(len(counts)), counts), *(np.ascontiguousarray(records[f"c{k}"]) for k in range(len(kinds))))
