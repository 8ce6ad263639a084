"""Vectorised helpers on Arrow batches of text: slices of bounded size, words and their hashes.

A word is a maximal run of bytes other than space and \\t\\n\\v\\f\\r, with A-Z lower-cased. Words and
shingles are held as 64-bit hashes; offsets are byte offsets into the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 19
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values() -> np.ndarray:
    """A random odd 64-bit value for each byte, equal for a letter's two cases."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER)) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


@cache
def _word_byte() -> np.ndarray:
    table = np.ones(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier modulo 2**64, and their inverses."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _POWERS[i] = p
    return _POWERS[0], _POWERS[1]


def text_array(column: pa.Array) -> pa.Array:
    """The column as large binary, nulls empty: one plain buffer and 64-bit offsets."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
        column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of rows of about `limit` bytes."""
    column = text_array(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@cache
def letter_byte() -> np.ndarray:
    """ASCII letters and all bytes of other characters."""
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and for each row the index of its first word (n + 1 values).

    kind: which bytes belong to words; all but white space if not given.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = (_word_byte() if kind is None else kind)[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_values()[data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return starts, ends, hashes, np.searchsorted(starts, offsets)


_SHINGLE = [np.uint64(m) for m in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of `size` words.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    _, _, hashes, first = words(data, offsets)
    m = len(hashes)
    rolled = np.zeros(max(0, m - size + 1), np.uint64)
    for j in range(size):
        rolled += hashes[j : j + len(rolled)] * _SHINGLE[j % 5] + np.uint64(j // 5)
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            whole = sum(int(h) * int(_SHINGLE[j % 5]) for j, h in enumerate(hashes[a:b])) + (b - a) * _MULTIPLIER
            out.append(mix(np.array([whole & (2**64 - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
