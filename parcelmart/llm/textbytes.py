"""Texts of an Arrow batch as one byte buffer: words, hashes of byte ranges, all without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A block of rows holds this many text bytes, or one longer text.
BLOCK_BYTES = 2_000_000
_ODD = 0x9E3779B97F4A7C15
_WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)


def flat_utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if array.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a block of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class RangeHash:
    """64-bit hashes of byte ranges, from one running sum: equal bytes have equal hashes wherever they stand."""

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.power = self.inverse = np.zeros(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.power) < n:
            size = max(n, BLOCK_BYTES + 1)
            self.power = _powers(_ODD, size)
            self.inverse = _powers(pow(_ODD, -1, 1 << 64), size)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.power[: n - 1], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def _table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


WHITE = _table(_WHITE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word ``[^\\x20\\x09-\\x0D]+``; words end where their text ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    black = ~WHITE[data]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = black[inner]
    last[inner - 1] = black[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def sorted_counts(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, the place of one row of each, and per key the sum of each further array."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], order[head], *(np.add.reduceat(s[order], head) if len(keys) else s[:0] for s in sums)
