"""Vectorised byte kernels over Arrow string columns.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``; all of
these separators are ASCII, so splitting UTF-8 bytes splits code points too.
Only A-Z are lower-cased.  Kernels work on blocks of about ``BLOCK_BYTES`` of
text, so that their temporaries stay bounded whatever the Arrow batch holds; a
text longer than a block is a block of its own and is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_CHAIN = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[str, np.ndarray] = {}


def separator_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


SEPARATOR = separator_table()
LOWER = lower_table()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of rows that hold about ``limit`` bytes each, in order."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs that don't cross a row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~cut[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~cut[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of words, and the index of each row's first word."""
    starts, ends = runs(~SEPARATOR[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial hash."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _CHAIN)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, width):
        total = total * _CHAIN + words[k : k + n]
    return mix(total)


def row_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of one row; fewer words than ``width`` are one shingle."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, width))


def shingle_sets(column, width: int):
    """Yield (row, sorted distinct shingle hashes) of lower-cased texts."""
    data, offsets = utf8(column)
    for first, last in blocks(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, where = word_bounds(part, at)
        words = span_hashes(part, starts, ends)
        for i in range(last - first):
            yield first + i, row_shingles(words[where[i] : where[i + 1]], width)
