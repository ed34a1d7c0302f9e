"""Numpy helpers that work on a whole Arrow column of texts at once.

Texts are looked at as UTF-8 bytes. Words are split on bytes below 0x80 only,
so byte positions and code points give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: bytes that end a word of class [^\x20\x09-\x0D]
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: lower case of A-Z, other bytes as they are
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mix_int(x: int) -> int:
    """``mix`` for one Python int."""
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def as_binary(column: pa.Array) -> pa.Array:
    """Texts as bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if column.type in (pa.large_string(), pa.large_binary()) else pa.binary()
    return column.cast(kind).fill_null(b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts (n + 1 offsets)."""
    b = as_binary(column)
    width = np.int64 if pa.types.is_large_binary(b.type) else np.int32
    offsets = np.frombuffer(b.buffers()[1], width)[b.offset : b.offset + len(b) + 1].astype(np.int64)
    if b.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(b.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(column: pa.Array, at_most: int = 1 << 20):
    """Slices (first row, rows) of about ``at_most`` bytes, one row at least."""
    _, offsets = flat(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + at_most, "right")) - 1)
        j = min(j, n)
        yield i, j - i
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = BLANKS):
    """Words as byte spans: starts, ends, and each row's first word (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = edges[edges > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        room = 1 << max(20, int(n).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(room, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ``values``: a polynomial, by prefix sums."""
    n = len(values)
    forth, back = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * forth[:n], out=total[1:])
    h = (total[ends] - total[starts]) * back[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    return run_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by where it starts (len - k + 1 values)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n]
    return mix(h)


def by_row(first: np.ndarray) -> np.ndarray:
    """Row number of each word, from each row's first word (n + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
