"""Vectorised helpers on Arrow string columns that several operators share.

A batch of texts is treated as one run of UTF-8 bytes, so that words, shingles
and their 64-bit hashes come from whole-array numpy operations instead of a
Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Fixed odd constants of the hash mixers (any odd 64-bit numbers do).
BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 mixing step)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * BASE)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the len + 1 offsets of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words, and per row the index of its first word (len + 1 of them).

    A word is a longest run without the six ASCII white-space characters; rows end words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    starts[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:]
    cut = cut[cut > 0] - 1
    ends[cut] = inside[cut]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, letters A-Z lowered: a polynomial in an odd base, read off prefix sums."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power = np.full(len(data) + 1, BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * power[:-1], out=total[1:])
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    back = np.full(len(data) + 1, inverse, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive hashes (rows are not looked at)."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    n = len(hashes) - length + 1
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = out * BASE + hashes[i : i + n]
    return mix64(out)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): per row the sorted distinct 64-bit hashes of its ``size``-word shingles.

    A row with fewer words has one shingle of all its words, a row without words none."""
    data, offsets = utf8(column)
    start, end, first = words(data, offsets)
    hashes = word_hashes(data, start, end)
    runs = run_hashes(hashes, size)
    sets, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= size:
            x = np.sort(runs[a : b - size + 1])
            if len(x) > 1:
                keep = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif b > a:
            x = run_hashes(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            continue
        sets.append(x)
        counts[row] = len(x)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return values, np.concatenate([[0], np.cumsum(counts)])
