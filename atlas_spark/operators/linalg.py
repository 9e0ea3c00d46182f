"""Blocked products of tall sparse tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

#: A tile holds about this many rows and columns, whatever the size of the table.
TILE_ROWS = 512
TILE_COLUMNS = 256


def gram(df: DataFrame, row: str, column: str, value: str, tile_rows: int = TILE_ROWS, tile_columns: int = TILE_COLUMNS) -> DataFrame:
    """(a, b, dot): dot products of every two columns over shared rows, for columns that share at least one row.

    Rows are dealt into chunks and columns into blocks by hash, as many as the distinct rows and columns ask for; only the place is
    chosen by the hash, rows and columns are matched by themselves.  A task multiplies two tiles at a time and emits their sums, so
    neither the rows of a column nor the pairs of a row are ever listed.  ``df`` has one value per (row, column); rows with a NULL in
    any of the three count for nothing.
    """
    cells = cut_lineage(df.select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("v")).dropna())
    parts = lambda key, size: F.greatest(F.ceil(F.approx_count_distinct(key) / size), F.lit(1))
    sizes = cells.agg(parts("r", tile_rows).alias("_chunks"), parts("c", tile_columns).alias("_blocks"))
    placed = cells.join(F.broadcast(sizes), F.lit(True)).select(F.pmod(F.xxhash64("r"), "_chunks").alias("chunk"),
                                                                F.pmod(F.xxhash64("c", F.lit(1)), "_blocks").alias("blk"), "_blocks", "r", "c", "v")
    tiles = placed.groupBy("chunk", "blk", "_blocks").agg(F.collect_list(F.struct("r", "c", "v")).alias("cells"))
    # every two blocks of a chunk are a key of their own
    left = tiles.select("chunk", F.col("blk").alias("i"), F.explode(F.sequence("blk", F.col("_blocks") - 1)).alias("j"), F.col("cells").alias("x"))
    right = tiles.select("chunk", F.col("blk").alias("j"), F.col("cells").alias("y"))
    pairs = left.join(right, ["chunk", "j"]).select("i", "j", "x", "y")

    def multiply(batches):
        for batch in batches:
            i, j, xs, ys = (batch.column(n) for n in ("i", "j", "x", "y"))
            for n in range(batch.num_rows):
                x, y = xs[n].values, ys[n].values
                shared = pa.concat_arrays([x.field("r"), y.field("r")]).dictionary_encode()
                codes, rows = shared.indices.to_numpy(zero_copy_only=False), len(shared.dictionary)
                mx, hx, cx = _dense(x, codes[:len(x)], rows)
                my, hy, cy = _dense(y, codes[len(x):], rows)
                a, b = np.nonzero(hx.T @ hy)
                dot = (mx.T @ my)[a, b]
                yield _products(cx.take(pa.array(a)), cy.take(pa.array(b)), dot)
                if i[n] != j[n]:
                    yield _products(cy.take(pa.array(b)), cx.take(pa.array(a)), dot)

    kind = dict(df.dtypes)[column]
    return pairs.mapInArrow(multiply, f"a {kind}, b {kind}, dot double").groupBy("a", "b").agg(F.sum("dot").alias("dot"))


def _dense(cells, codes, rows):
    """Values, marks of the values that are there, and names of the columns of a tile."""
    c = cells.field("c").dictionary_encode()
    at = codes, c.indices.to_numpy(zero_copy_only=False)
    m, h = np.zeros((rows, len(c.dictionary))), np.zeros((rows, len(c.dictionary)), dtype=np.float32)
    m[at] = cells.field("v").to_numpy(zero_copy_only=False)
    h[at] = 1
    return m, h, c.dictionary


def _products(a, b, dot):
    return pa.RecordBatch.from_arrays([a, b, pa.array(dot)], names=["a", "b", "dot"])
