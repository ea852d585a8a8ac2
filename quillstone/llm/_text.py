"""Vectorised word kernels over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. Words are named by a 64-bit hash: the
polynomial sum of random 64-bit letters, finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LETTER[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 20
_pow: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _BLOCK + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * _BLOCK:
            _pow[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each row's first word (with an end mark). apart: by byte."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = apart[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    edge = at[(at > 0) & (at < len(data))]
    before[edge] = True
    starts = np.flatnonzero(before & ~space)
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[edge - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the byte spans, A-Z taken as a-z. Memory is bounded by blocks of about a megabyte, or one word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _BLOCK, side="right")))
        b = int(ends[j - 1])
        part = _LETTER[data[a:b]]
        part *= _powers(_BASE, b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s = starts[i:j] - a
        out[i:j] = (total[ends[i:j] - a] - total[s]) * _powers(_INV, b - a)[s]
        i = j
    return mix64(out)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the words of each row."""
    data, at = buffers(column)
    starts, ends, first = spans(data, at)
    return hash_spans(data, starts, ends), first


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text, or one row."""
    _, at = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of a text's word hashes; a shorter text is one shingle; none without words."""
    n = len(h)
    if not n:
        return h
    if n < k:
        return mix64(np.array([np.sum(h * _SHINGLE[:n], dtype=np.uint64) + U(n)], np.uint64))
    s = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        s += h[j : n - k + 1 + j] * _SHINGLE[j]
    s = np.sort(mix64(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
