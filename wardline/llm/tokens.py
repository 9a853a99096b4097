"""Vectorised words and hashes over Arrow text columns (numpy on the raw UTF-8 bytes).

A text column's bytes lie in one buffer, one text after the other; words, shingles and their hashes are computed over the
whole buffer at once and cut at the texts' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
GAP = np.zeros(256, dtype=bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64), in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(table: pa.Table | pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.Table | pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text each, one row at least."""
    if not table.num_rows:
        return
    c = table[column]
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
    _, offsets = buffer_of(c)
    at = 0
    while at < table.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield table.slice(at, end - at)
        at = end


def word_bounds(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more than texts)."""
    n = len(flat)
    full = ~GAP[flat]
    starts, ends = full.copy(), full.copy()
    if n:
        starts[1:] &= ~full[:-1]
        ends[:-1] &= ~full[1:]
        edge = offsets[:-1][(offsets[:-1] < n) & (offsets[1:] > offsets[:-1])]
        starts[edge] = full[edge]
        edge = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        ends[edge] = full[edge]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = _power_tables(len(flat) + 1)
    total = np.empty(len(flat) + 1, np.uint64)
    total[0] = 0
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs_hash(units: np.ndarray, k: int, starts: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive units (of those at ``starts``); units are 64-bit hashes or bytes."""
    n = len(units)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    if starts is None:
        return mix((total[k:] - total[:-k]) * down[: n - k + 1])
    return mix((total[starts + k] - total[starts]) * down[starts])


def shingles(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles, and for each text the number of its first (one more than texts).

    Letters A-Z count as a-z. A text with fewer than ``k`` words but some has one shingle, its whole sequence.
    """
    s, e, first = word_bounds(flat, offsets)
    units = span_hashes(LOWER[flat], s, e)
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(n)])
    if not len(units):
        return np.zeros(0, np.uint64), begin
    doc = np.repeat(np.arange(len(counts)), n)
    start = np.arange(begin[-1]) - begin[doc] + first[doc]
    length = np.minimum(counts, k)[doc]
    up, down = _power_tables(len(units) + 1)
    total = np.empty(len(units) + 1, np.uint64)
    total[0] = 0
    np.cumsum((units + np.uint64(1)) * up[: len(units)], out=total[1:])
    return mix((total[start + length] - total[start]) * down[start] + length.astype(np.uint64)), begin
