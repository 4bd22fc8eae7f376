"""Vectorised scanning of Arrow text columns: words, word hashes and rolling hashes of word windows.

Texts stay UTF-8 bytes in Arrow's own buffers. A hash of bytes [s, e) is a difference of a prefix sum of
``table[byte] * base**i`` (modulo 2**64) times ``base**-s``; windows of words are hashed the same way over word
hashes. Work is done in chunks of whole texts, so memory follows the chunk and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_U = np.uint64
_MASK = (1 << 64) - 1
_BYTE_BASE, _WORD_BASE, _SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD5
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything of ASCII but letters and digits, for words without punctuation.
NOT_ALNUM = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        if size > 4 * CHUNK_BYTES:  # not kept: one huge text must not hold memory for good
            return out[0], out[1]
        have = _POWERS[base] = (out[0], out[1])
    return have


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Scan:
    """Words of consecutive texts: byte ranges, 64-bit hashes, and the range of words of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _IS_SPACE):
        raw = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.raw = raw
        n = len(raw)
        word = ~separators[raw]
        cut = np.zeros(n + 1, bool)  # a text starts here
        cut[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | cut[:n]))
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | cut[1 : n + 1])) + 1
        self.hashes = mix(_ranges(_TABLE[raw], self.starts, self.ends, _BYTE_BASE) ^ (self.ends - self.starts).astype(np.uint64))
        #: word_at[i]: index of the first word of text i; word_at[-1]: number of words.
        self.word_at = np.searchsorted(self.starts, self.offsets, "left")
        self.counts = np.diff(self.word_at)

    def window_starts(self, size: int) -> np.ndarray:
        """Indices of the words at which a window of ``size`` words of one text starts."""
        ok = np.zeros(len(self.starts) + 1, np.int32)
        lens = np.maximum(self.counts - size + 1, 0)
        has = lens > 0
        np.add.at(ok, self.word_at[:-1][has], 1)
        np.add.at(ok, (self.word_at[:-1] + lens)[has], -1)
        return np.flatnonzero(np.cumsum(ok[:-1]) > 0)

    def window_hashes(self, starts: np.ndarray, size: int, second: bool = False) -> np.ndarray:
        values = mix(self.hashes + _U(0x632BE59BD9B4E019)) if second else self.hashes
        return mix(_ranges(values, starts, starts + size, _SECOND_BASE if second else _WORD_BASE))

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """Index of the text that each word is of."""
        return np.searchsorted(self.word_at, words, "right") - 1


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def scans(column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES, lower: bool = False, separators: np.ndarray = _IS_SPACE) -> Iterator[tuple[int, int, Scan]]:
    """(first row, row after the last, Scan) for chunks of whole texts."""
    base = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        raw, offsets = buffers(part)
        at = 0
        while at < len(part):
            to = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1
            to = min(max(to, at + 1), len(part))
            yield base + at, base + to, Scan(raw, offsets[at : to + 1], lower, separators)
            at = to
        base += len(part)
