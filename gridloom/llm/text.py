"""Bytes, words and hashes of many texts at once, straight from Arrow columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20


def give_back() -> None:
    """Return freed memory to the system between pieces, where the C library can; idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each piece (one row at least)."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n+1 offsets of its rows; a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for a list of byte strings."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes (``is_word``: 256 flags), and n+1 word offsets of the rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edges[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edges[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# One odd base for all sums, so that a worker keeps two tables of its powers; seeds choose the codes.
_BASE = int(mix(np.array([3], np.uint64))[0]) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


@cache
def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte."""
    return mix(np.arange(256, dtype=np.uint64) + np.uint64((seed + 1) << 20))


class Rolling:
    """Polynomial hashes, modulo 2**64, of any stretch of a sequence of 64-bit codes.

    One running sum serves every stretch: a stretch costs a subtraction and a product.
    """

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.up = _powers(_BASE, self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(codes * _powers(_INVERSE, self.n), dtype=np.uint64, out=self.sums[1:])

    def stretches(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.up[starts])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all stretches of ``width`` codes, by start."""
        if self.n < width:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[: self.n + 1 - width]) * self.up[: self.n + 1 - width])


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, covered = values, 1
    while covered < width:
        step = min(covered, width - covered)
        out = np.minimum(out[: len(out) - step], out[step:])
        covered += step
    return out


def flat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + count), one range after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of all [start, end), one after another."""
    return data[flat_ranges(starts, ends - starts)]
