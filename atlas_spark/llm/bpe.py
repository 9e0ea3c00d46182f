"""Byte-level BPE on length-bucketed padded matrices.

The distinct pieces of a chunk of texts are put into matrices by length.  In each round every row merges its
leftmost pair of least rank; ranks of pairs come from a hash table in numpy arrays, only the pairs beside a merge are
looked up again, and rows that have no pair left leave the matrix.  Pieces over WIDE bytes, where shifting a row on
each merge would cost the square of its length, are merged by the same rule with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

WIDE = 256
CACHE_PIECES = 200_000
CHUNK_BYTES = 2 << 20
NO_RANK = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of a ``.tiktoken`` file with a hash table from pairs of ids to the id of their merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        keys, values = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(np.ceil(np.log2(3 * max(1, len(keys))))))
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        self.probes = 0
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # linear probing: in each round the first claimant of a free slot gets it
            self.probes += 1
            s = slot[left]
            free = self.keys[s] == 2**64 - 1
            won = left[free]
            self.keys[s[free]] = keys[won]
            got = self.keys[s] == keys[left]
            self.values[s[got]] = values[left[got]]
            left = left[~got]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.blob, self.at = _blob(self.tokens)
        self.decimal, self.decimal_at = _blob([b"%d " % i for i in range(size)])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NO_RANK where there is none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], NO_RANK)
        open_ = np.flatnonzero((seen != keys) & (seen != 2**64 - 1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen != 2**64 - 1)]
        return out

    def _matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes."""
        n = len(rows)
        size = np.fromiter(map(len, rows), np.int64, n)
        ids = np.zeros((n, width + 1), np.int32)
        inside = np.arange(width + 1)[None, :] < size[:, None]
        ids[inside] = self.of_byte[np.frombuffer(b"".join(rows), np.uint8)]
        rank = np.full((n, width), NO_RANK, np.int32)
        pair = inside[:, 1:]
        rank[pair] = self.merged(ids[:, :-1][pair], ids[:, 1:][pair])
        done: list = [None] * n
        row = np.arange(n)
        while len(row):
            k = rank.argmin(1)
            every = np.arange(len(row))
            best = rank[every, k]
            go = best != NO_RANK
            if not go.all():
                for i in np.flatnonzero(~go):
                    done[row[i]] = ids[i, :size[i]].copy()
                ids, rank, size, row, k, best = ids[go], rank[go], size[go], row[go], k[go], best[go]
                if not len(row):
                    break
                every = np.arange(len(row))
                most = int(size.max())
                ids, rank = ids[:, :most + 1], rank[:, :most]
            # close the gap at k + 1 in every row
            w = ids.shape[1]
            col = np.arange(w - 1)[None, :]
            src = col + (col > k[:, None])
            ids[:, :-1] = np.take_along_axis(ids, src, 1)
            ids[every, k] = best
            src = np.minimum(src[:, :-1], rank.shape[1] - 1) if rank.shape[1] > 1 else None
            if src is not None:
                rank[:, :-1] = np.take_along_axis(rank, src, 1)
            rank[:, -1] = NO_RANK
            size = size - 1
            right = k + 1 < size
            rank[every, k] = NO_RANK
            r = np.flatnonzero(right)
            rank[r, k[r]] = self.merged(best[r], ids[r, k[r] + 1])
            left = np.flatnonzero(k > 0)
            rank[left, k[left] - 1] = self.merged(ids[left, k[left] - 1], best[left])
        return done

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank(i):
            j = nxt[i]
            return self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]]) if j < n else None
        first = self.merged(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = nxt[i]
            ids[i], alive[j], nxt[i] = r, False, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for x in (prev[i], i):
                if x >= 0 and (q := rank(x)) is not None:
                    heapq.heappush(heap, (q, x))
        return np.array([x for x, a in zip(ids, alive) if a], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, encoded on its own."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            elif not p:
                out[i] = np.zeros(0, np.int32)
            elif len(p) > WIDE:
                out[i] = self._heap(p)
            else:
                buckets.setdefault(min(w for w in (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, WIDE) if w >= len(p)), []).append(i)
        for width, at in buckets.items():
            step = max(1, (1 << 19) // width)
            for a in range(0, len(at), step):
                part = at[a:a + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out


def _blob(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat parts of the entries ``which`` one after the other, their offsets)."""
    size = (at[1:] - at[:-1])[which]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return flat[np.arange(total) + np.repeat(at[:-1][which] - (end - size), size)], np.concatenate([[0], end])


class Encoder:
    """Encodes and decodes texts; keeps the ids of up to CACHE_PIECES pieces of the texts before."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.split = _vocabulary(path), regex.compile(pattern)
        self.code: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets by text)."""
        if len(self.code) > CACHE_PIECES:
            self.code = {}
            self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        found = [self.split.findall(t) for t in texts]
        code, new = self.code, []
        for p in set().union(*found):
            if p not in code:
                code[p] = len(code)
                new.append(p)
        if new:
            ids = self.vocabulary.encode_pieces([p.encode("utf-8") for p in new])
            self.flat = np.concatenate([self.flat, *ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids])])
        which = np.fromiter((code[p] for f in found for p in f), np.int64, sum(map(len, found)))
        ids, at = gather(self.flat, self.at, which)
        return ids, at[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of texts from their ids."""
        raw, end = gather(self.vocabulary.blob, self.vocabulary.at, ids)
        return raw, end[at]

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(decimal ids, each followed by a blank, offsets)."""
        raw, end = gather(self.vocabulary.decimal, self.vocabulary.decimal_at, ids)
        return raw, end[at]


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for i, t in enumerate(batch.column("text")):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size > CHUNK_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def bpe(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and decoded_equal, and with the ids if asked for.

    Every match of ``pattern`` is encoded on its own without special tokens, then the ids are decoded again.
    ``path`` is a rank file that all executors have.  NULL and empty texts have no tokens; repeated rows come out
    once each.  Columns of these names in ``docs`` are replaced, all others pass through.
    """
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "decoded_equal": "boolean"} | ({"ids": "array<int>"} if ids else {})
    keep = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(path, pattern)
        for batch in batches:
            for first, texts in _chunks(batch):
                got, at = e.encode(texts)
                raw, raw_at = e.decode(got, at)
                dec, dec_at = e.decimals(got, at)
                raw, dec = memoryview(raw), memoryview(dec)
                a, b = [], []
                same = []
                for i, t in enumerate(texts):
                    body = raw[raw_at[i]:raw_at[i + 1]]
                    a.append(hashlib.sha256(dec[dec_at[i]:max(dec_at[i], dec_at[i + 1] - 1)]).hexdigest())
                    b.append(hashlib.sha256(body).hexdigest())
                    same.append(body == t.encode("utf-8"))
                cols = [pa.array(np.diff(at), pa.int64()), pa.array(a), pa.array(b), pa.array(same)]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(got)))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], [*keep, *added])
    plain = docs.select(*[F.col(c) for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + ", " + ", ".join(f"{k} {v}" for k, v in added.items())
    return plain.mapInArrow(run, schema)
