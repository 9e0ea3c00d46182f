"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

Every document's distinct word shingles are put in one global order (rare first).  Two sets whose
Jaccard similarity reaches the threshold share at least ``l`` of the first ``n - required + l``
shingles of both, for every l; a document chooses its own l by the estimated cost of its candidates:
documents made of frequent shingles read a longer prefix and ask for more shared shingles, so fewer
candidates reach the exact check.  A pair uses the smaller l of the two, which stays exact.

Equal sets are one node.  Nodes that are alike enough to the first node of a list form families, whose members are compared in
block cells once and not in every list; pairs across families are counted list by list.  Parities of the sets (one bit
per shingle) rule out most candidates exactly, so whole sets are shipped only for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from . import cells as C, text as T
from .components import components

CELL_BITS = 20
MAX_MATCH = 4
#: cost of an exact check in units of one index row read, and rows expected for a shingle that no cell shows as repeated
CHECK_COST = 8.0
CHANCE = 0.2
#: lists over this size are compared in block cells of their own
LONG_LIST = 512
#: as many (doc_id, id) rows are broadcast to the scan that cuts their sets again; more of them are joined by a shuffle
BROADCAST_ROWS = 200_000
#: percentage from which the members of a family look alike: copies of one text may be less alike than linked ones, unrelated texts
#: turn more parities than this allows
ALIKE = 70


def _texts(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*[F.col(k) for k in keep], F.col("text").cast("string").alias("text"))


def frequent_cells(docs: DataFrame, n: int) -> np.ndarray:
    """Levels (log2 of the count) of hash cells that hold repeated shingles; a fixed-size table of 2**CELL_BITS bytes.

    Counts cover all texts: each chunk of texts gives the shingles that it holds more than once, summed by cell.
    The table only steers the global order, every order is correct.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for part in T.pieces(batch, limit=2 * T.CHUNK_BYTES):
                h, off = T.shingles(T.words(part.column("text")), n)
                if len(h):
                    u, c = np.unique(np.concatenate(list(T.distinct_sets(h, off))), return_counts=True)
                    often = c > 1
                    np.add.at(total, (u[often] >> np.uint64(64 - CELL_BITS)).astype(np.int64), c[often])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "c"])
    got = _texts(docs).mapInArrow(run, "cell bigint, c bigint").groupBy("cell").agg(F.sum("c").alias("c"))
    t = got.toArrow()
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[t["cell"].to_numpy()] = np.ceil(np.log2(t["c"].to_numpy().astype(float) + 1)).astype(np.uint8)
    return levels


def ordered(u: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Distinct hashes in the global order: by level of their cell, then by hash."""
    return u[np.lexsort((u, levels[(u >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))]


def required(size: int, percent: int) -> int:
    """Least overlap of a set of this size with any set that it is linked with."""
    return -(-percent * size // 100)


def matches(o: np.ndarray, levels: np.ndarray, percent: int) -> int:
    """Number of shared prefix shingles to ask for: least estimated cost of index rows read plus candidates checked."""
    base = len(o) - required(len(o), percent) + 1
    often = np.exp2(levels[(o[:base + MAX_MATCH - 1] >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(float))
    best, least = 1, np.inf
    for k in range(1, MAX_MATCH + 1):
        if base + k - 1 > len(o):
            break
        read = often[:base + k - 1].sum() - (1 - CHANCE) * (base + k - 1)
        cost = read + CHECK_COST * read / k
        if cost < least * 0.999:
            best, least = k, cost
    return best


def _signature(u: np.ndarray) -> int:
    """64 bits of a set, from the sums of its hashes and of a mix of them; stands for the set as its node number."""
    second = T._mixed(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    both = np.array([u.sum(dtype=np.uint64)]) ^ T._mixed(np.array([second]))
    return int(T._mixed(both).view(np.int64)[0])


def signatures(docs: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, sig, asked, prefix, bits) per row; sig is NULL for texts without words, asked is the number of matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lev = levels.value
        for batch in batches:
            for part in T.pieces(batch):
                size, sig, asked, prefix, bits = [], [], [], [], []
                for u in T.distinct_sets(*T.shingles(T.words(part.column("text")), n)):
                    size.append(len(u))
                    sig.append(_signature(u) if len(u) else None)
                    o = ordered(u, lev)
                    k = matches(o, lev, percent) if len(u) else 0
                    asked.append(k)
                    bits.append(C.parities(u) if len(u) else None)
                    prefix.append(o[:len(o) - required(len(o), percent) + k].view(np.int64))
                at = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
                flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(sig, pa.int64()), pa.array(asked, pa.int32()),
                                                  pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(bits, pa.binary())],
                                                 ["doc_id", "n_shingles", "sig", "asked", "prefix", "bits"])
    d = _texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return d.mapInArrow(run, "doc_id bigint, n_shingles bigint, sig bigint, asked int, prefix array<bigint>, bits binary")


def _sets(docs: DataFrame, wanted: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """(id, bin, aux) of the wanted (doc_id, id): hashes in global order, and the number of matches asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lev = levels.value
        for batch in batches:
            for part in T.pieces(batch):
                ids, bins, aux = [], [], []
                for i, u in zip(part.column("id").to_pylist(), T.distinct_sets(*T.shingles(T.words(part.column("text")), n))):
                    if len(u) and _signature(u) == i:  # rows may share a doc_id
                        o = ordered(u, lev)
                        ids.append(i)
                        bins.append(o.tobytes())
                        aux.append(matches(o, lev, percent))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bins, pa.binary()), pa.array(aux, pa.int64())], ["id", "bin", "aux"])
    few = wanted.count() <= BROADCAST_ROWS
    d = _texts(docs, "doc_id").join(F.broadcast(wanted) if few else wanted, "doc_id").select("id", "text")
    return d.mapInArrow(run, "id bigint, bin binary, aux bigint").dropDuplicates(["id"])


def _linked(percent: int):
    def linked(i, j, sets, full, aux, cache):
        a, b = len(sets[i]), len(sets[j])
        if 100 * min(a, b) < percent * max(a, b):
            return False
        k = min(aux[i], aux[j])
        pi, pj = (_prefix(x, k, sets, percent, cache) for x in (i, j))
        if len(pi & pj) < k:
            return False
        both = len(full[i] & full[j])
        return 100 * both >= percent * (a + b - both)
    return linked


def _prefix(i, k, sets, percent, cache):
    if (i, k) not in cache:
        cache[i, k] = frozenset(sets[i][:len(sets[i]) - required(len(sets[i]), percent) + k])
    return cache[i, k]


def families(members: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(id, fam) of the ids that share lists with the same least id, two of them or as many as asked for, and look alike by their sizes and
    parities (``marks``, as for ``narrow_cells``); chained.

    Shared shingles alone would chain texts by chance, the more of them the larger the table, and one family would hold most texts in
    the end.  Only a way to meet most candidates once instead of in every list that they share; pairs across families are found by
    ``across``, so no link depends on it.
    """
    star = members.filter("id <> least").groupBy("id", "least").agg(F.count("*").alias("n"), F.min("asked").alias("asked"))
    near = star.filter(F.col("n") >= F.least("asked", F.lit(2)))
    near = C.narrow_cells(C.pair_cells(near.select(F.col("id").alias("a"), F.col("least").alias("b"))), marks, min(percent, ALIKE))
    edges = near.groupBy("cell").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    fam = components(cut_lineage(edges.select("a", "b")))
    return cut_lineage(fam.select(F.col("node").alias("id"), F.col("label").alias("fam")))


def across(members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Cells for candidates of different families: pairs of sizes that can link and that share as many prefix shingles as asked
    for, and long lists in blocks.  ``facts(id, n_shingles, fam)`` has the size and the family of each member."""
    w = W.partitionBy("g")
    mixed = members.select("g", "id", "asked").join(facts, "id").withColumn("mixed", F.min("fam").over(w) != F.max("fam").over(w))
    mixed = cut_lineage(mixed.withColumn("size", F.count("*").over(w)).filter("mixed").drop("mixed"))
    short, long_ = mixed.filter(F.col("size") <= LONG_LIST), mixed.filter(F.col("size") > LONG_LIST)
    a, b = (short.select("g", *[F.col(c).alias(f"{c}_{n}") for c in ("id", "fam", "asked", "n_shingles")]) for n in "ab")
    sizes = 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    pairs = a.join(b, "g").filter("id_a < id_b and fam_a <> fam_b").filter(sizes).groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    pairs = pairs.agg(F.count("*").alias("n"), F.min(F.least("asked_a", "asked_b")).alias("k"))
    return C.pair_cells(pairs.filter("n >= k")).unionByName(C.into_cells(C.distinct_groups(long_.select("g", "id"))))


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs(doc_id, text, ...)``.

    Two texts link when 100 * intersection >= percent * union of their distinct shingles of ``words`` words
    (between blanks, A-Z in lower case); component_id is the least doc_id reachable.  Texts with fewer
    words are one shingle; NULL, empty and blank texts have no shingle and stay alone.  Rows with a NULL
    doc_id keep their shingle count and have the component of the texts that they equal or link with
    (NULL if none of those has an id); repeated rows come out once per row.  Other columns are ignored.
    Shingles and sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(frequent_cells(docs, words))
    sig = cut_lineage(signatures(docs, levels, words, percent))
    reps = cut_lineage(sig.filter("sig is not null and doc_id is not null").groupBy(F.col("sig").alias("id")).agg(*[F.min(c).alias(c) for c in ("doc_id", "n_shingles", "asked", "prefix", "bits")]))
    members = C.shared(reps.select(F.explode("prefix").alias("g"), "id", "asked"), "asked", least=True)
    marks = reps.select("id", F.col("bits").alias("bin"), F.col("n_shingles").alias("aux"))
    fam = families(members, marks, percent)
    size = fam.groupBy("fam").agg(F.count("*").alias("size")).filter("size > 1")
    alike = fam.join(size, "fam").select(F.col("fam").alias("g"), "id", "size")
    facts = reps.select("id", "n_shingles").join(fam, "id", "left").withColumn("fam", F.coalesce("fam", "id"))
    cells = C.into_cells(alike).unionByName(across(members, facts, percent))
    cells = cut_lineage(C.narrow_cells(cells, marks, percent))
    wanted = cut_lineage(cells.select("id").distinct().join(reps.select("id", "doc_id"), "id").select("doc_id", "id"))
    edges = C.link_cells(cells, _sets(docs, wanted, levels, words, percent), _linked(percent))
    comp = components(cut_lineage(edges))
    label = sig.select("doc_id", "n_shingles", "sig").join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = label.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = label.join(least, "label", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
