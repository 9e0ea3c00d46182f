"""What each filter of a chain removes in every order: masks of failed filters, walked subset by subset in Gray-code order.

Spark reduces the documents to one row per part with a cell for each mask of failed filters (32 for five filters).
The walk switches one filter at a time: each mask's counter of active failures goes up or down by one, and the
running survivors change by the cells whose counter leaves or reaches zero.  A step of an order is the difference of
the survivors of two stored subsets, so the orders cost no further look at the cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: What is counted of the documents of a cell.
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

_WORD = r"[^\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """Failures that a text shows by itself; the words must be an array column named ``words``."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def masks(failures: Mapping[str, Column]) -> Column:
    """Failures as a number with bit i set for the i-th filter; an unknown answer is no failure."""
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())]
    return sum(bits[1:], bits[0])


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic): a narrow row per document with its failures of filters A to E and its labels.

    E compares texts by their SHA-256.  The first document of a text is looked up by its own id, not by its text, so
    that thousands of copies of a text do not meet in one task.  A NULL text is empty, a NULL source is the part '';
    a NULL doc_id has no smaller one and is nobody's smaller one; labels of one id that come more than once count
    by their largest value.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"))
    d = cut_lineage(d.select("doc_id", "part", masks(text_failures(F.col("text"))).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    first = d.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    d = d.join(first, ["doc_id", "digest"], "left").join(marks.filter("doc_id is not null"), "doc_id", "left")
    copied = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return d.select("part", (F.col("mask") + F.when(copied, 16).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(rows: DataFrame, filters: int) -> DataFrame:
    """(part, n, good, toxic): per part the counts of every mask, as arrays in the order of the masks."""
    per = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("bigint").alias("good"), F.sum("toxic").cast("bigint").alias("toxic"))
    zero = F.lit(0).cast("bigint")
    return per.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(x))), zero) for m in range(1 << filters)]).alias(x) for x in MEASURES])


def survivors(cell: np.ndarray) -> np.ndarray:
    """States ``[subset, part, measure]`` of ``cell[mask, part, measure]``: what passes the filters of each subset.

    Subsets are visited in Gray-code order, so that each differs from the one before by one filter.
    """
    size = len(cell)
    masks_, active = np.arange(size), np.zeros(size, np.int64)
    states = np.empty_like(cell)
    running, subset = cell.sum(axis=0), 0
    states[0] = running
    for step in range(1, size):
        bit = step & -step  # the filter that the Gray code switches at this step
        subset ^= bit
        touched = masks_[(masks_ & bit) > 0]
        if subset & bit:
            running = running - cell[touched[active[touched] == 0]].sum(axis=0)
            active[touched] += 1
        else:
            active[touched] -= 1
            running = running + cell[touched[active[touched] == 0]].sum(axis=0)
        states[subset] = running
    return states


def audit(cell: np.ndarray) -> np.ndarray:
    """Counts ``[part, order, step, count]`` (COUNTS) of all orders of the filters, from ``cell[mask, part, measure]``."""
    filters = len(cell).bit_length() - 1
    states = survivors(cell)
    every = states[0]
    orders = list(permutations(range(filters)))
    out = np.zeros((cell.shape[1], len(orders), filters, len(COUNTS)), np.int64)
    shapley = np.zeros((filters, cell.shape[1]), np.int64)
    for o, order in enumerate(orders):
        before = 0
        for s, f in enumerate(order):
            after = before | 1 << f
            gone = states[before] - states[after]
            fails = every[:, 0] - states[1 << f][:, 0]
            out[:, o, s, :6] = np.stack([states[after][:, 0], gone[:, 0], fails - gone[:, 0], cell[1 << f, :, 0], gone[:, 1], gone[:, 2]], axis=1)
            shapley[f] += gone[:, 0]
            before = after
    for o, order in enumerate(orders):
        out[:, o, :, 6] = shapley[list(order)].T
    return out


def orders_of(parts: DataFrame, names: str) -> DataFrame:
    """A row per part, order of the filters and step, from ``parts`` (``cells``)."""
    orders = ["".join(names[f] for f in order) for order in permutations(range(len(names)))]
    steps = len(names)
    fields = ["part", "filter_order", "step", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                b = batch.slice(first, 100)
                part = b.column("part").to_pylist()
                cell = np.stack([np.array(b.column(x).to_pylist(), np.int64).reshape(len(part), -1) for x in MEASURES], axis=-1)
                counts = audit(cell.transpose(1, 0, 2)).reshape(-1, len(COUNTS))
                each = len(orders) * steps
                columns = [pa.array([p for p in part for _ in range(each)], pa.string()), pa.array([o for o in orders for _ in range(steps)] * len(part), pa.string()),
                           pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(part) * len(orders)))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in np.ascontiguousarray(counts.T)]], fields)
    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of filters A to E.

    Reads doc_id, text and source of ``docs`` and doc_id, quality and toxic of ``labels``; other columns are not read.
    Repeated rows are documents of their own (E needs a smaller id).  An empty table has no parts and gives no rows.
    """
    return orders_of(cells(failing(docs, labels), 5), "ABCDE")
