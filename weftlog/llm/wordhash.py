"""Vectorised words and hashes over the UTF-8 buffers of Arrow string columns.

Nothing here makes a Python string for a word: word borders, lower case, word hashes and rolling window
hashes are NumPy operations over the bytes of many documents at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
SLICE = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have, size = np.ones(1, np.uint64), 1
        while size < n:
            have = np.concatenate([have, have * np.uint64(pow(base, size, 1 << 64))])
            size *= 2
        if n <= 2 * SLICE:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE, rows: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of at most ``rows`` rows with at most ``limit`` bytes, or one longer row; null is empty."""
    if (tokens := sys.modules.get(f"{__package__}.tokens")) is not None:
        tokens.release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n, at + (rows or n))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def class_table(separators: str | None = None, members: bytes | None = None) -> np.ndarray:
    """256 booleans: True for bytes of words, given the bytes that separate or the bytes that belong."""
    table = np.ones(256, bool)
    if members is not None:
        table[:] = False
        table[list(members)] = True
    if separators is not None:
        table[[ord(c) for c in separators]] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, per document, the number of words of the first and later documents (a running count)."""
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, then mixed."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_INVERSE, len(data) + 1)[starts])


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes; documents are not kept apart here."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _STEP[0]
    for k in range(1, width):
        out = out + hashes[k : k + n] * _STEP[k]
    return mix(out + np.uint64(width) * _STEP[63])


#: Words of the near-duplicate operators end at blank, tab, line feed, vertical tab, form feed and carriage return.
SPACED = class_table(separators=" \t\n\x0b\x0c\r")
#: Words of the leak scan are ASCII letters and digits and everything beyond ASCII.
ALNUM = class_table(members=bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each document's word shingles: lower-cased A-Z; fewer than ``width`` words: one."""
    for first, data, offsets in slices(column):
        data = LOWER[data]
        starts, ends, count = words(data, offsets, SPACED)
        hashes = word_hashes(data, starts, ends)
        whole = window_hashes(hashes, width)
        for k in range(len(offsets) - 1):
            a, b = count[k], count[k + 1]
            if b - a >= width:
                got = np.sort(whole[a : b - width + 1])
                yield first + k, got[np.concatenate([[True], got[1:] != got[:-1]])]
            elif b > a:
                yield first + k, window_hashes(hashes[a:b], int(b - a))
            else:
                yield first + k, np.zeros(0, np.uint64)
