"""Whole-array work on the bytes of many texts: words, hashes of words and of word shingles.

A hash of a byte string is a polynomial over random values of its bytes modulo 2**64, mixed
at the end. Prefix sums give the hash of any stretch without touching it again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for later calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and the offsets of its rows in them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums whose differences are hashes of stretches, still scaled by their starts."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    scale = powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * scale[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it is in; words never go over the end of a row."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``size`` lower-cased words; a shorter text is one run of all its words."""
    data, offsets = buffer_of(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    if not len(starts):
        return rows, np.zeros(0, dtype=np.uint64)
    words = stretch_hashes(prefix_hashes(data), starts, ends)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    # k words are hashed into sums[k]; the number of words is part of the hash
    sums, shift = [np.zeros_like(words)], words
    for k in range(size):
        shift = words if k == 0 else np.append(words[k:], np.zeros(min(k, len(words)), dtype=np.uint64))[: len(words)]
        sums.append(mix(sums[-1] * _BASE + shift + _U(k + 1)))
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    here = counts[rows]
    full = place + size <= here
    hashes = sums[size].copy()
    for k in range(1, size):
        short = (here == k) & (place == 0)
        hashes[short] = sums[k][short]
        full |= short
    return rows[full], hashes[full]


def distinct(rows: np.ndarray, hashes: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then by ``rank`` if given, then by hash."""
    order = np.lexsort((hashes, rows) if rank is None else (hashes, rank, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]
