"""Words of whole Arrow text batches as numpy arrays: bounds and 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of any pieces of a sequence from one running sum; equal pieces get equal hashes anywhere."""

    def __init__(self):
        self.up, self.down = powers(BASE, 1 << 16), powers(INVERSE, 1 << 16)

    def sums(self, values: np.ndarray) -> np.ndarray:
        if len(values) > len(self.up):
            n = 1 << len(values).bit_length()
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=out[1:])
        return out

    def pieces(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inside = np.minimum(start, len(self.down) - 1)
        raw = (sums[end] - sums[start]) * self.down[inside]
        return mix(raw ^ (np.uint64(0xD6E8FEB86659FD93) * (end - start).astype(np.uint64)))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Parts of a batch of about ``most`` bytes of text; one row is never split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows on end, and the offsets of the rows; null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of true bytes that do not leave their row."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(n, bool)
    before[1:] = member[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(member & ~before)
    after = np.zeros(n, bool)
    after[:-1] = member[1:]
    after[edges[edges > 0] - 1] = False
    return starts, np.flatnonzero(member & ~after) + 1


def word_table() -> np.ndarray:
    """Which bytes belong to a word: ASCII letters and digits, and all bytes of other characters."""
    out = np.zeros(256, bool)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return out


def fold_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


WORD_BYTES, FOLDED = word_table(), fold_table()


def words(data: np.ndarray, offsets: np.ndarray, hasher: Hasher):
    """Word starts, ends, hashes and the first word of each row (length rows + 1)."""
    starts, ends = runs(WORD_BYTES[data], offsets)
    sums = hasher.sums(FOLDED[data])
    return starts, ends, hasher.pieces(sums, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words on end and their row bounds; a row of fewer words gives one shingle of all its words."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(n)), counts)
    at = first[:-1][row] + np.arange(bounds[-1]) - bounds[:-1][row]
    last = first[1:][row]
    out = np.zeros(bounds[-1], np.uint64)
    for j in range(k):
        there = at + j
        value = np.where(there < last, hashes[np.minimum(there, len(hashes) - 1)] if len(hashes) else 0, np.uint64(7))
        out = mix(out + value * np.uint64(BASE) + np.uint64(j))
    return out, bounds
