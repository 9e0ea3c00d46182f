"""Quality classifier: naive Bayes log-count ratios under a linear hinge-loss model.

Features are indicators of n-grams: one to three bytes of the text, and runs of up to four word shapes (case, symbols,
repetition of the word before), hashed into DIM cells.  Each is scaled by its log-count ratio; the weights are
fitted by dual coordinate descent.  Both use bounded samples of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import text as T

GRAM_DIM = 1 << 16
SHAPE_DIM = 1 << 12
DIM = GRAM_DIM + SHAPE_DIM
#: bound of the labelled rows that the ratios are taken from, and of those among them that the weights are fitted on
RATIO_ROWS = 20_000
SAMPLE_ROWS = 3000
ALPHA = 1.0
COST = 1.0
EPOCHS = 30
#: share of the plain model kept against the mean weight, as usual for such models
BETA = 0.25

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _shapes(w: T.Words) -> np.ndarray:
    """0..7 per word: repeated from the word before, all upper case, ends in a symbol, has a digit, one byte, short, long, other."""
    size = w.end - w.start
    if not len(size):
        return size

    def count(table):
        c = np.concatenate([[0], np.cumsum(table[w.raw])])
        return c[w.end] - c[w.start]
    out = np.where(size > 14, 6, np.where(size < 4, 5, 7))
    out = np.where(size == 1, 4, out)
    out = np.where(count(_DIGIT) > 0, 3, out)
    out = np.where(_SYMBOL[w.raw[w.end - 1]], 2, out)
    out = np.where((count(_UPPER) * 2 > size) & (size > 1), 1, out)
    same = np.zeros(len(size), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.first[:-1][w.first[:-1] < len(size)]] = False
    return np.where(same, 0, out)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted cell numbers of the n-grams that each text holds."""
    raw, off = T.offsets(column)
    w = T.words(column)
    shape = _shapes(w)
    b = raw.astype(np.uint32)
    flags = np.zeros(DIM, bool)
    for i in range(len(off) - 1):
        x, s = b[off[i]:off[i + 1]], shape[w.first[i]:w.first[i + 1]]
        flags[:] = False
        flags[x] = True
        if len(x) > 1:
            two = x[:-1] << 8 | x[1:]
            flags[(two * np.uint32(0x9E3779B1)) >> np.uint32(16)] = True
            if len(x) > 2:
                three = (two[:-1] << 8 | x[2:]) + np.uint32(0x1000000)
                flags[(three * np.uint32(0x85EBCA77)) >> np.uint32(16)] = True
        code = 0
        for n in range(4):
            if len(s) > n:
                code = s if n == 0 else code[:-1] * 8 + s[n:]
                flags[GRAM_DIM + (code + (8 ** (n + 1) - 8) // 7) % SHAPE_DIM] = True
        yield np.flatnonzero(flags).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, column: pa.Array) -> np.ndarray:
        return np.array([self.weights[f].sum() / np.sqrt(max(1, len(f))) + self.bias for f in features(column)])

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.shift, -30, 30)))


def ratios(train: DataFrame) -> np.ndarray:
    """Log-count ratio of every cell over all rows of ``train(text, label)``; counts are summed per task, then by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, DIM), np.int64)
        for batch in batches:
            for part in T.pieces(batch):
                for y, f in zip(part.column("label").to_pylist(), features(part.column("text"))):
                    total[y][f] += 1
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["cell", "n0", "n1"])
    t = train.mapInArrow(run, "cell bigint, n0 bigint, n1 bigint").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n = np.zeros((2, DIM))
    n[0, t["cell"].to_numpy()], n[1, t["cell"].to_numpy()] = t["n0"].to_numpy(), t["n1"].to_numpy()
    p = (n + ALPHA) / (n + ALPHA).sum(1, keepdims=True)
    return np.log(p[1] / p[0])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on scaled indicators, by coordinate descent in the dual.

    A row is its cells' ratios divided by the root of their number; the bias is a constant feature.
    """
    w, bias, a = np.zeros(DIM), 0.0, np.zeros(len(rows))
    x = [r[f] / np.sqrt(max(1, len(f))) for f in rows]
    q = np.array([v @ v + 1 for v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(a[i] - g / q[i], 0), cost[i])
            if (step := new - a[i]) != 0:
                w[rows[i]] += step * y[i] * x[i]
                bias += step * y[i]
                a[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of margins, by Newton steps on smoothed targets."""
    hi, lo = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (hi + 1) / (hi + 2), 1 / (lo + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def sampled(docs: DataFrame, labels: DataFrame, rows: int = RATIO_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, half of each class where there are enough: the least doc_id hashes.

    ``labels(doc_id, label)`` is cut to that bound first, so its ids can be broadcast and no text is shuffled.  Rows with a
    NULL id or a label other than 0 and 1 are left out, NULL texts are empty.
    """
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    half = [labels.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for y in (0, 1)]
    ids = half[0].unionByName(half[1])
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.join(F.broadcast(ids), "doc_id").select("text", "label")  # at most ``rows`` ids


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from ``train(text, label)``, labels 0 and 1.

    Ratios use all rows given; weights use at most ``sample_rows``, half of each class where there are enough, those with the
    least text hashes.  With one class only the score is 0 or 1 by that class, without any row it is one half.
    """
    train = cut_lineage(train)
    r = ratios(train)
    got = [train.filter(F.col("label") == y).orderBy(F.xxhash64("text"), "text").limit(sample_rows // 2) for y in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([f.tobytes() for f in features(part.column("text"))], pa.binary())], ["label", "f"])
    t = got[0].unionByName(got[1]).mapInArrow(run, "label int, f binary").toArrow()
    y = 2.0 * t["label"].to_numpy() - 1
    rows = [np.frombuffer(b.as_py(), np.int32) for b in t["f"]]
    if not (y > 0).any() or not (y < 0).any():
        share = 0.5 if not len(y) else float((y > 0).any())
        return Model(np.zeros(DIM), 0.0, 1.0, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    order = np.random.default_rng(11).permutation(len(rows))
    margin = np.zeros(len(rows))
    cost = np.full(len(rows), COST)

    def model(at):
        w, bias = dual_descent([rows[i] for i in at], y[at], r, cost[at])
        return ((1 - BETA) * np.abs(w).mean() + BETA * w) * r, BETA * bias
    for k in range(3):  # margins of rows that the weights have not seen, for the curve
        out = order[k::3]
        w, bias = model(np.setdiff1d(order, out))
        margin[out] = [w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias for i in out]
    w, bias = model(order)
    return Model(w, bias, *_platt(margin, y))


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of each text, 0 to 1; NULL and empty texts have the score of a text without n-grams.

    Only the text is an input.  A column of the same name is replaced; repeated rows have equal scores.
    """
    keep = [c for c in docs.columns if c != column]
    # a fixed number of weights, as plain values: workers may lack this package
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*held.value)
        for batch in batches:
            for part in T.pieces(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(known.scores(part.column("text")))], [*keep, column])
    plain = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + f", {column} double"
    return plain.mapInArrow(run, schema)
