"""Vectorised text primitives over Arrow buffers: words, word hashes, shingles.

All functions work on whole texts. Null texts count as empty. A chunk of rows is processed at a time, so memory follows the
chunk and the longest single text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    kept = _powers.get(base)
    if kept is None or len(kept) <= n:
        full = np.full(1 << max(16, int(n).bit_length()), base, np.uint64)
        full[0] = 1
        kept = _powers[base] = np.multiply.accumulate(full)
    return kept[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if column.type == pa.large_string() else b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system: workers stay alive between tasks, next to those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows and about limit bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_string())
        _, offsets = raw(sizes)
        start, n = 0, batch.num_rows
        while start < n:
            end = min(start + rows, max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1))
            yield batch.slice(start, end - start)
            start = end
    release()


def eights(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each (non-empty) range as little-endian numbers of eight bytes, the last padded with zeros, and the bounds of
    each range's numbers."""
    n = -(-(ends - starts) // 8)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    place = np.repeat(starts - 8 * bounds[:-1], n) + 8 * np.arange(bounds[-1])
    padded = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
    padded[: len(data)] = data
    whole, at, shift = padded.view("<u8"), place >> 3, ((place & 7) << 3).astype(np.uint64)
    out = (whole[at] >> shift) | ((whole[at + 1] << np.uint64(1)) << (np.uint64(63) - shift))
    left = np.minimum(np.repeat(ends, n) - place, 8).astype(np.uint64)
    return out & (~np.uint64(0) >> ((np.uint64(8) - left) << np.uint64(3))), bounds


def hashes_of_eights(numbers: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each range: the sum of its numbers, each mixed with a random one for its place, mixed with the size in bytes."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    n = np.diff(bounds)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
    salts = mix((np.arange(1, int(n.max()) + 1, dtype=np.uint64)) * _GOLD)
    return mix(np.add.reduceat(mix(numbers ^ salts[place]), bounds[:-1]) + sizes.astype(np.uint64) * _GOLD)


def equal_eights(a: np.ndarray, a_bounds: tuple[np.ndarray, np.ndarray], b: np.ndarray, b_bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of ranges of numbers, given by their beginnings and lengths in a and in b, those that are equal pairwise."""
    (a_at, a_n), (b_at, b_n) = a_bounds, b_bounds
    same = a_n == b_n
    n = a_n[same]
    if len(n):
        begin = np.cumsum(n) - n
        inner = np.arange(n.sum())
        differ = a[np.repeat(a_at[same] - begin, n) + inner] != b[np.repeat(b_at[same] - begin, n) + inner]
        same[same] = np.add.reduceat(differ, begin, dtype=np.int64) == 0
    return same


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a column: hashes (A-Z lower-cased if asked), the row of each, and rows' word ranges.

    cuts, a function of the bytes, may part words further; space says which bytes part them. numbers holds the words' bytes, eight
    in each, so that words can be compared where a hash of 64 bits is not enough.
    """

    def __init__(self, column: pa.Array, lower: bool = True, cuts=None, space: np.ndarray = SPACE):
        data, offsets = raw(column)
        self.rows, n = len(offsets) - 1, len(data)
        inside = ~space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
        if cuts is not None and n:  # further bounds: cuts(data) says where a word ends before a byte
            cut = cuts(data)
            first |= cut & inside
            last[:-1] |= cut[1:] & inside[:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.numbers, self.number_at = eights(LOWER[data] if lower else data, self.starts, self.ends)
        self.hashes = hashes_of_eights(self.numbers, self.number_at, self.ends - self.starts)
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.bounds = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.data, self.offsets = data, offsets


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each shingle of so many words, rows in order; a shorter non-empty row gives its whole sequence once."""
    h, n = words.hashes, len(words.hashes)
    counts = np.diff(words.bounds)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        total += h[j : n - size + 1 + j] * _PLACE[j]
    full = words.row[: len(total)] == words.row[size - 1 :] if n >= size else np.zeros(0, bool)
    hashes, rows = mix(total[full]), words.row[: len(total)][full]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.array([int((h[words.bounds[r] : words.bounds[r + 1]] * _PLACE[: counts[r]]).sum(dtype=np.uint64)) for r in short], np.uint64)
        hashes = np.concatenate([hashes, mix(own + _PLACE[40 + counts[short]])])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes within each row, and the n_rows + 1 bounds of the rows."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(n_rows + 1))
