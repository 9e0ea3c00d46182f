"""Exact links inside groups of any size, as block cells that give a spanning set of links.

A group of g members is cut into blocks of BLOCK; every pair of blocks is a cell with at most two
blocks of sets, so no task holds a whole group and no pair is emitted: a cell gives at most one link
per member, enough for the components of the exact link graph.  Groups with the same members are
handled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage

BLOCK = 256


def shared(members: DataFrame, *carry: str, least: bool = False) -> DataFrame:
    """Distinct (g, id) of the groups that hold two ids or more, with the least of the carried columns and, if asked for, the
    ``least`` id of the group; one shuffle of the rows."""
    w = W.partitionBy("g")
    several = members.withColumn("least", F.min("id").over(w)).withColumn("_several", F.col("least") != F.max("id").over(w)).filter("_several")
    carry = (*carry, "least") if least else carry
    return cut_lineage(several.groupBy("g", "id").agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in carry]).drop("_n"))


def distinct_groups(members: DataFrame) -> DataFrame:
    """members(g, id) without groups of one member and without groups whose members equal another group's."""
    h1, h2 = F.xxhash64("id"), F.hash("id").cast("bigint")
    size = members.groupBy("g").agg(F.count("*").alias("size"), F.sum(F.pmod(h1, F.lit(1 << 40))).alias("s1"), F.sum(h2).alias("s2"),
                                    F.min("id").alias("least"), F.max("id").alias("last")).filter("size > 1")
    keep = size.groupBy("size", "s1", "s2", "least", "last").agg(F.min("g").alias("g")).select("g", "size")
    return members.join(keep, "g")


def into_cells(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cell, side, id) rows of members(g, id, size): each member once per cell it takes part in, that is once for every block
    of its group.  Side 2 marks the cell of one block; in a cell of two blocks only pairs of different sides are compared."""
    d = members.withColumn("nb", F.ceil(F.col("size") / block).cast("int"))
    d = d.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb").cast("bigint")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1)
    return d.select(F.xxhash64("g", F.least("blk", "other"), F.greatest("blk", "other")).alias("cell"), side.alias("side"), "id")


def pair_cells(pairs: DataFrame) -> DataFrame:
    """A cell for each pair (a, b)."""
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("id")), F.struct(F.lit(1).alias("side"), F.col("b").alias("id")))
    return pairs.select(F.xxhash64("a", "b").alias("cell"), F.explode(both).alias("e")).select("cell", "e.side", "e.id")


def _links(ids: list, bins: list, sizes: list, sides: list, linked: Callable) -> Iterator[tuple]:
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    sets = [np.frombuffer(b, np.uint64).tolist() for b in bins]
    full = [frozenset(s) for s in sets]
    cache: dict = {}
    for i in range(len(ids)):
        for j in range(i):
            if sides[i] == sides[j] != 2:
                continue
            a, b = find(i), find(j)
            if a != b and ids[i] != ids[j] and linked(i, j, sets, full, sizes, cache):
                root[a] = b
                yield ids[i], ids[j]


def _per_cell(cells: DataFrame, sets: DataFrame, fields: list[str], found: Callable, partitions: int | None = None) -> DataFrame:
    """Rows of bigint ``fields`` that ``found(cell, ids, bins, aux, sides)`` gives for the members of each cell.

    A cell is read as a run of sorted rows, so a task holds one cell at a time.
    """
    rows = cells.join(sets, "id").select("cell", "id", "bin", "aux", "side")
    n = partitions or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "cell").sortWithinPartitions("cell")

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, ([], [], [], [])
        out: list[tuple] = []
        for batch in batches:
            for c, *row in zip(*(batch.column(k).to_pylist() for k in ("cell", "id", "bin", "aux", "side"))):
                if c != cell:
                    out += found(cell, *held)
                    cell, held = c, ([], [], [], [])
                for column, x in zip(held, row):
                    column.append(x)
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        out += found(cell, *held)
        yield batch_of(out)
    return rows.mapInArrow(run, ", ".join(f"{f} bigint" for f in fields))


def link_cells(cells: DataFrame, sets: DataFrame, linked: Callable, partitions: int | None = None) -> DataFrame:
    """(a, b) links of members of a cell; ``sets(id, bin, aux)`` has the hashes of each id in an order of its own choice.

    ``linked(i, j, sets, full, aux, cache)`` decides on members i and j of the cell.
    """
    return _per_cell(cells, sets, ["a", "b"], lambda cell, *held: _links(*held, linked), partitions)


def _parts(ids: list, bits: list, sizes: list, sides: list, percent: int) -> Iterator[tuple]:
    """(member, root) of the members chained by pairs that their parities cannot rule out."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    width = [8 * len(b) for b in bits]
    value = [int.from_bytes(b, "little") for b in bits]

    def folded(i, w):
        x, n = value[i], width[i]
        while n > w:
            n //= 2
            x = (x >> n) ^ (x & ((1 << n) - 1))
        return x
    by_width = {w: [folded(i, w) if width[i] >= w else 0 for i in range(len(ids))] for w in set(width)}
    for i in range(len(ids)):
        for j in range(i):
            a, b = sizes[i], sizes[j]
            if sides[i] == sides[j] != 2 or 100 * min(a, b) < percent * max(a, b):
                continue
            x, y = find(i), find(j)
            if x != y:
                of = by_width[min(width[i], width[j])]
                if (of[i] ^ of[j]).bit_count() * (100 + percent) <= (a + b) * (100 - percent):
                    root[x] = y
    top = [find(i) for i in range(len(ids))]
    alone = [True] * len(ids)
    for i, r in enumerate(top):
        if i != r:
            alone[i] = alone[r] = False
    return ((i, r) for i, r in enumerate(top) if not alone[i])


def narrow_cells(cells: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The cells cut into the parts that may hold links, so that only their members need whole sets; parts of one member go.

    ``marks(id, bin, aux)`` has the parities (``parities``) and the size of each set.  A hash that only one of two sets holds
    turns one bit, so the differing bits never outnumber the differing hashes: no pair at ``percent`` is ruled out.
    """
    def found(cell, ids, bits, sizes, sides):
        return [(cell, ids[r], sides[i], ids[i]) for i, r in _parts(ids, bits, sizes, sides, percent)]
    parts = _per_cell(cells, marks, ["cell", "root", "side", "id"], found)
    return parts.select(F.xxhash64("cell", "root").alias("cell"), F.col("side").cast("int").alias("side"), "id")


def parities(u: np.ndarray) -> bytes:
    """Per bucket of hashes (low bits, as many buckets as hashes or up to twice that) whether it holds an odd number of them."""
    n = 1 << max(6, (len(u) - 1).bit_length())
    odd = np.bincount((u & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
