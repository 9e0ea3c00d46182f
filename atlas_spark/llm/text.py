"""Words and shingles of Arrow text batches as numpy arrays, without a Python object per word.

All functions take the texts of one batch as bytes with offsets, so that their cost follows the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BASE = np.uint64(0x9FB21C651E98DF25)


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)[:max(n, 1)]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``limit`` bytes of text; a longer text comes alone."""
    size = np.diff(offsets(batch.column(column))[1])
    first, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many leading underscores as it takes to clash with no column of ``df``."""
    mark = "_"
    while any(c.lower() in {mark + n for n in names} for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def offsets(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; NULL counts as empty."""
    a = a.cast(pa.large_binary()) if a.type != pa.large_binary() else a
    if a.null_count:
        a = a.fill_null(b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(a) else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    """Words of several texts in a row: hash, first byte and byte after the last; text i has words first[i]..first[i+1]."""
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    raw: np.ndarray


def words(a: pa.Array, lower: bool = True) -> Words:
    """Words between white space (tab to carriage return, blank), A-Z in lower case, as 64-bit hashes."""
    raw, off = offsets(a)
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64), raw)
    inside = ~_SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False  # a text begins a new word
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    size = end - start
    first = np.searchsorted(start, off)
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, end, first, raw)
    at = np.cumsum(size) - size
    bytes_ = raw[inside]
    value = _BYTE[_LOWER[bytes_] if lower else bytes_]
    value *= _powers(int(size.max()))[np.arange(len(bytes_)) - np.repeat(at, size)]
    return Words(_mixed(np.add.reduceat(value, at) + size.astype(np.uint64)), start, end, first, raw)


def shingles(w: Words, n: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n-word shingles, offsets by text); a text of fewer words is one shingle, one without words has none."""
    first = w.first if first is None else first
    total, count = len(w.hash), np.diff(first)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    stop = np.repeat(first[1:], count)
    i = np.arange(total)
    acc = np.zeros(total, np.uint64)
    used = np.minimum(stop - i, n)
    power = _powers(n, np.uint64(0xC2B2AE3D27D4EB4F))
    for k in range(n):
        ok = used > k
        acc[ok] += w.hash[i[ok] + k] * power[k]
    acc = _mixed(acc + used.astype(np.uint64))
    keep = (used == n) | ((i == np.repeat(first[:-1], count)) & (np.repeat(count, count) < n))
    per = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    return acc[keep], np.concatenate([[0], np.cumsum(per)])


def distinct_sets(hashes: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text."""
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield np.unique(hashes[a:b])
