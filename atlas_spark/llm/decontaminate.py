"""Benchmark leaks by latent semantic retrieval: randomised SVD of TF-IDF passages, cosine candidates, then exact checks.

One pass over all passages sums document frequencies and the product of the passages with a sparse random matrix; the
factorisation of that product on the driver (fixed size) gives the leading singular vectors.  A second pass compares every window of the
documents with the windows of the benchmark items in that space; candidates are confirmed by their longest
common subsequence with the whole item or with one window of it, and by the item's last sentence.  Beside it hashed
word runs find verbatim quotes exactly, of parts of items and of items too short for the search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as T

TERM_BITS = 13
TERMS = 1 << TERM_BITS
RANK = 64
SKETCH = 128
HALF = 12             # a window is two halves; windows begin at every half
COSINE = 0.55         # items with a fifth of their words replaced had 0.65 or more
SHARE = 0.4           # share of an item window's words that a candidate window must hold before the sequences are compared
COPIED = 0.8          # common subsequence over the item's words: a copy
REWORDED = 0.6        # the same for a reworded one, whose last sentence must be there as well
ANSWER = 0.8
MIN_WORDS = 8
QUOTED = 20           # equal words in a row of an item that are a leak whatever its length; items of fewer words count as a whole
ITEM_BLOCK = 2000
CHUNK = 1 << 19


def _terms(w: T.Words) -> np.ndarray:
    return (w.hash >> np.uint64(64 - TERM_BITS)).astype(np.int32)


def _halves(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each half window, number of halves of each text)."""
    count = np.diff(first)
    n = -(-count // HALF)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first[:-1], n) + HALF * inside, n


def sketch(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(passages that hold each term, T'G, number of passages) over all texts, for term counts T and a random sparse G.

    G puts every passage into one of SKETCH columns with a random sign, so a word costs one addition and E[T'G G'T] = T'T.
    """
    cols = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, s, passages = np.zeros(TERMS, np.int64), np.zeros(TERMS * SKETCH), 0
        for batch in batches:
            for part in T.pieces(batch, limit=CHUNK):
                w = T.words(part.column("text"))
                if not len(w.hash):
                    continue
                t, (at, _) = _terms(w), _halves(w.first)
                draw = T._mixed(w.hash[at] + np.arange(len(at), dtype=np.uint64))
                size = np.diff(np.append(at, len(t)))
                key = t * SKETCH + np.repeat((draw % np.uint64(SKETCH)).astype(np.int32), size)
                up = np.repeat((draw >> np.uint64(63)).astype(bool), size)
                s += np.bincount(key[up], minlength=TERMS * SKETCH)
                s -= np.bincount(key[~up], minlength=TERMS * SKETCH)
                order = np.argsort(t.astype(np.uint16), kind="stable")
                which, sorted_ = np.repeat(np.arange(len(at), dtype=np.int32), size)[order], t[order]
                new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | (which[1:] != which[:-1])])
                df += np.bincount(sorted_[new], minlength=TERMS)
                passages += len(at)
        used = np.flatnonzero(df)
        m = s.reshape(TERMS, SKETCH)[used]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], passages))] + [pa.array(np.append(m[:, i], 0.0)) for i in range(SKETCH)], ["term", "df", *cols])
    d = docs.select(F.col("text").cast("string").alias("text"))
    rows = d.mapInArrow(run, "term bigint, df bigint, " + ", ".join(f"{c} double" for c in cols))
    t = rows.groupBy("term").agg(F.sum("df").alias("df"), *[F.sum(c).alias(c) for c in cols]).toArrow()  # TERMS + 1 rows at most
    df, s, passages = np.zeros(TERMS), np.zeros((TERMS, SKETCH)), 0
    term = t["term"].to_numpy()
    real = term >= 0
    if len(term):
        df[term[real]] = t["df"].to_numpy()[real]
        s[term[real]] = np.stack([t[c].to_numpy() for c in cols], 1)[real]
        passages = int(t["df"].to_numpy()[~real].sum())
    return df, s, passages


def term_vectors(df: np.ndarray, s: np.ndarray, passages: int) -> np.ndarray:
    """Latent coordinates of one occurrence of each term: its weight times its row of the leading singular vectors.

    With A = T W, W the inverse document frequencies, W s = A'G is the randomised range of A's rows; its left
    singular vectors stand for the right ones of A.  The first directions tell languages and sources apart and would make any two
    passages of one language alike: a direction above the
    middle singular value of those in use is scaled by the square of its share, whatever the size of the corpus.
    """
    idf = np.log1p((passages + 1) / (df + 1))
    u, sigma, _ = np.linalg.svd(idf[:, None] * s, full_matrices=False)
    u, sigma = u[:, :RANK], sigma[:RANK]
    real = sigma > 1e-9 * max(sigma[0], 1e-30)
    middle = np.median(sigma[real]) if real.any() else 1.0
    return (idf[:, None] * u * np.where(real, np.minimum(1, (middle / np.maximum(sigma, 1e-30)) ** 2), 0)).astype(np.float32)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _windows(w: T.Words, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit latent vectors, first words, text numbers) of all windows; a text of up to two halves has one."""
    at, n = _halves(w.first)
    t = np.append(_terms(w), TERMS)
    stop = np.minimum(at + HALF, np.repeat(w.first[1:], n))
    padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    half = np.zeros((len(at), vectors.shape[1]), np.float32)
    for k in range(HALF):
        half += padded[t[np.where(at + k < stop, at + k, len(t) - 1)]]
    text = np.repeat(np.arange(len(n)), n)
    more = np.append(text[1:] == text[:-1], False)
    x = half.copy()
    x[more] += half[1:][more[:-1]]
    keep = more | np.concatenate([[True], text[1:] != text[:-1]])  # a last half stands alone only as the only one
    return _units(x[keep]), at[keep], text[keep]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    where: dict[int, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _runs(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the runs of n words of each text."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    u = np.zeros(len(at), np.uint64)
    for k, power in enumerate(T._powers(n)):
        u += h[at + k] * power
    return at, T._mixed(u)


class _Items:
    """Windows, words and last sentences of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: pa.Array, vectors: np.ndarray):
        w = T.words(texts)
        self.ids = ids
        h = w.hash.tolist()
        self.words = [h[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
        self.answers = []
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            stop = [k for k in range(a, b - 1) if w.raw[w.end[k] - 1] in b".!?"]
            self.answers.append(h[(stop[-1] + 1) if stop else a:b])
        size = np.diff(w.first)
        self.runs = []  # (length, sorted hashes, their items)
        for n in sorted({min(int(k), QUOTED) for k in size if k}):
            at, u = _runs(w.hash, w.first, n)
            of = np.searchsorted(w.first, at, "right") - 1
            ok = np.minimum(size[of], QUOTED) == n
            order = np.argsort(u[ok], kind="stable")
            self.runs.append((n, u[ok][order], of[ok][order]))
        if len(h):
            self.x, at, self.item = _windows(w, vectors)
            keep = np.array([len(self.words[i]) >= MIN_WORDS for i in self.item], bool)
            self.x, at, self.item = self.x[keep], at[keep], self.item[keep]
            self.parts = [h[a:min(a + 2 * HALF, int(w.first[i + 1]))] for a, i in zip(at.tolist(), self.item.tolist())]
            t = _terms(w)
            self.holds = np.zeros((len(at), TERMS + 1), bool)
            self.size = np.zeros(len(at))
            for k, (a, i) in enumerate(zip(at.tolist(), self.item.tolist())):
                b = min(a + 2 * HALF, w.first[i + 1])
                self.holds[k, t[a:b]] = True
                self.size[k] = b - a
        else:
            self.x = np.zeros((0, vectors.shape[1]), np.float32)


def _search(part: pa.RecordBatch, items: _Items, vectors: np.ndarray) -> Iterator[tuple]:
    w = T.words(part.column("text"))
    best: dict = {}
    if len(w.hash) and len(items.x):
        _retrieve(w, items, vectors, best)
    for d, n, lo, hi in _quotes(w, items):
        if (d, n) not in best:
            m = len(items.words[n])
            region = w.hash[max(int(w.first[d]), lo - m):min(int(w.first[d + 1]), hi + m)].tolist()
            best[d, n] = lcs(region, items.words[n]) / m, lcs(region, items.answers[n]) / len(items.answers[n]), None
    for (d, n), found in best.items():
        yield d, items.ids[n], *found


def _quotes(w: T.Words, items: _Items) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, end) of the first verbatim run of an item in each text."""
    seen = set()
    for n, known, of in items.runs:
        at, u = _runs(w.hash, w.first, n)
        lo = np.searchsorted(known, u)
        for k in np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == u).tolist():
            d = int(np.searchsorted(w.first, at[k], "right")) - 1
            for i in of[lo[k]:np.searchsorted(known, u[k], "right")].tolist():
                if (d, i) not in seen:
                    seen.add((d, i))
                    yield d, i, int(at[k]), int(at[k]) + n


def _retrieve(w: T.Words, items: _Items, vectors: np.ndarray, best: dict) -> None:
    """Adds (text, item): (lcs share, answer share, cosine) of the latent search to ``best``."""
    x, at, text = _windows(w, vectors)
    t = np.append(_terms(w), TERMS)
    stop = np.minimum(at + 2 * HALF, w.first[text + 1])
    pos = at[:, None] + np.arange(2 * HALF)[None, :]
    held_terms = t[np.where(pos < stop[:, None], pos, len(t) - 1)]
    for lo in range(0, len(x), 2048):
        cos = x[lo:lo + 2048] @ items.x.T
        hit = np.flatnonzero(cos.ravel() >= COSINE)
        for c in range(0, len(hit), 20_000):
            ii, kk = np.divmod(hit[c:c + 20_000], len(items.x))
            a, end = at[lo + ii], stop[lo + ii]
            held = items.holds[kk[:, None], held_terms[lo + ii]].sum(1)
            for j in np.flatnonzero(held >= SHARE * np.minimum(items.size[kk], end - a)).tolist():
                d, n = int(text[lo + ii[j]]), int(items.item[kk[j]])
                m = len(items.words[n])
                first = max(int(w.first[d]), int(a[j]) - m)
                region = w.hash[first:min(int(w.first[d + 1]), int(end[j]) + m)].tolist()
                share, part = lcs(region, items.words[n]) / m, items.parts[kk[j]]
                near = w.hash[max(int(w.first[d]), int(a[j]) - HALF):min(int(w.first[d + 1]), int(end[j]) + HALF)].tolist()
                stretch = len(part) >= QUOTED and lcs(near, part) >= max(QUOTED, COPIED * len(part))
                if share >= REWORDED or stretch:
                    answer = lcs(region, items.answers[n]) / len(items.answers[n])
                    if share >= COPIED or answer >= ANSWER or stretch:
                        best[d, n] = max(best.get((d, n), (0,)), (share, answer, float(cos[ii[j], kk[j]])))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    for r in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _over(docs: DataFrame, benchmark: DataFrame, each, schema: str, columns: list[str]) -> list[DataFrame]:
    """``each(part, found)`` over the rows of docs, one table for each block of items."""
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(term_vectors(*sketch(docs)))  # a fixed number of terms
    out = []
    for block in _blocks(benchmark):
        held = sc.broadcast(block)  # ITEM_BLOCK items

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            v = vectors.value
            items = _Items([i for i, _ in held.value], pa.array([t for _, t in held.value], pa.string()), v)
            for batch in batches:
                for part in T.pieces(batch, limit=CHUNK):
                    yield each(part, list(_search(part, items, v)))
        out.append(docs.select(*columns).mapInArrow(run, schema))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_share, cosine) of the benchmark items found in ``docs(doc_id, text, ...)``.

    Words stand between blanks and are compared in lower case of A-Z.  Every window of every text is compared with every item
    of ``benchmark(item_id, text)``, in blocks of ITEM_BLOCK items.  A run of QUOTED equal words of an item, or QUOTED words in order out of
    one of its windows, is a leak however long the item is.  Items of fewer than MIN_WORDS words are not searched by windows but found where all
    their words stand in a row; a leak found by equal words alone has a NULL cosine.  NULL and empty texts match nothing, an empty benchmark gives no rows.  Items that repeat
    give a row each; a NULL doc_id or item_id stays NULL.  Other columns are not read.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, lcs_share double, answer_share double, cosine double"

    def rows(part: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        doc = part.column("doc_id").to_pylist()
        got = [(doc[i], item, *x) for i, item, *x in found]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "lcs_share", "answer_share", "cosine"])
    out = _over(d, benchmark, rows, schema, ["doc_id", "text"])
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds nothing, with all their columns; the rules of ``leaks`` hold."""
    for block in _blocks(benchmark):
        part_of = docs.sparkSession.createDataFrame(block, "item_id bigint, text string")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

        def rows(part: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            ok = np.ones(part.num_rows, bool)
            ok[[i for i, *_ in found]] = False
            return part.filter(pa.array(ok))
        docs = _over(docs, part_of, rows, schema, docs.columns)[0]
    return docs
