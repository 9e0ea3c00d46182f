"""Feature vectors: scaling, projection, clustering, similarity, neighbours, gridding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .ranking import best_row, grouped_ranks
from .relational import top_n

TILE = 1024
#: Vectors of a leaf of the pivot tree, on average.
CELL = 1024
#: Leaves searched before the search has a bound.
NEAR = 4
#: Distances by products are exact to less than this share of the lengths of the two vectors.
SLACK = 1e-6
#: Portions of the vectors that members stream past, and the most bytes of vectors in one.
PORTIONS = 48
PORTION_BYTES = 64 << 20
#: Members and vectors that a scan compares at a time (fewer vectors without a bound), exact distances at a time, and candidates before they are cut.
SCAN_MEMBERS, SCAN_ROWS, SCAN_OPEN, SCAN_EXACT, SCAN_WAITING = 1024, 4096, 128, 65_536, 1 << 20
#: Neighbours kept beyond k, so that ties at the cut are settled by rounded distances.
SPARES = 4
#: Bytes of a block of vectors as doubles, and the least number of blocks, in the tiles of listed pairs.
PAIR_BYTES = 16 << 20
PAIR_BLOCKS = 16
#: Vectors of this many numbers are shuffled with each pair, as they are about as small as the ids that tiles ship in their place.
PAIR_SHORT = 8


def log1p_scale(df: DataFrame, clip: float = 10.0) -> DataFrame:
    """log1p, z-score per dimension with the sample deviation, upper clip.  ``df``: (vec_id, dim, v)."""
    x = df.withColumn("v", F.log1p("v"))
    s = x.groupBy("dim").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    z = (F.col("v") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return x.join(s, "dim").withColumn("v", F.least(z, F.lit(clip))).drop("_m", "_s")


def _features(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_f", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def pca(df: DataFrame, column: str, components: int) -> DataFrame:
    """Principal components of centred vectors as an array column ``pcs``."""
    f = _features(df, column)
    c = StandardScaler(inputCol="_f", outputCol="_c", withMean=True, withStd=False).fit(f).transform(f)
    p = PCA(k=components, inputCol="_c", outputCol="_p").fit(c).transform(c)
    return p.withColumn("pcs", vector_to_array("_p")).drop("_f", "_c", "_p")


def kmeans(df: DataFrame, column: str, k: int, seed: int = 1, max_iter: int = 20) -> DataFrame:
    f = _features(df, column)
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="cluster").fit(f).transform(f).drop("_f")


def cosine_pairs(vectors: DataFrame, pairs: DataFrame, id_col: str, column: str, block_bytes: int = PAIR_BYTES, least: int = PAIR_BLOCKS,
                 short: int = PAIR_SHORT) -> DataFrame:
    """Cosine similarity of listed pairs (a, b); NULL where a vector has no length or a gap, or the two differ in size.

    The vectors are dealt into blocks and the pairs into tiles of two blocks.  A vector goes to a tile once, however many of its pairs
    name it, and pairs are shuffled as ids alone.  Inside a tile the vectors come first and the pairs stream past them.  Vectors of up
    to ``short`` numbers are joined to their pairs.
    """
    n, size = vectors.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    if size <= short:
        return _joined_cosines(vectors, pairs, id_col, column)
    kind = vectors.select(id_col).union(pairs.select("a")).union(pairs.select("b")).dtypes[0][1]
    numbers = F.col(column) if dict(vectors.dtypes)[column] == "array<float>" else F.col(column).cast("array<double>")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = vectors.select(F.col(id_col).cast(kind).alias("id"), numbers.alias("vec")).filter("id is not null").withColumn("norm", norm)
    blocks = max(least, math.ceil(n * max(size, 1) * 8 / block_bytes))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    p = pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).filter("a is not null and b is not null")
    p = p.select(block("a").alias("i"), block("b").alias("j"), "a", "b")
    end = lambda c, side: p.select("i", "j", F.lit(side).alias("side"), F.col(c).alias("id"))
    held = end("a", 0).unionByName(end("b", 1)).distinct().join(v, "id").select("i", "j", "side", F.col("id").alias("a"), F.col("id").alias("b"), "vec", "norm")
    asked = p.select("i", "j", F.lit(2).alias("side"), "a", "b", F.lit(None).cast(dict(v.dtypes)["vec"]).alias("vec"), F.lit(None).cast("double").alias("norm"))
    rows = held.unionByName(asked).repartition("i", "j").sortWithinPartitions("i", "j", "side")

    def run(batches):
        tile, parts, sides = None, ([], []), None
        for batch in batches:
            i, j, side = (batch.column(c).to_numpy() for c in range(3))
            new = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(i)]):
                if lo == hi:
                    continue
                if (i[lo], j[lo]) != tile:
                    tile, parts, sides = (i[lo], j[lo]), ([], []), None
                rows = batch.slice(lo, hi - lo)
                if side[lo] < 2:
                    parts[side[lo]].append(_unit_rows(rows.column("a"), rows.column("vec"), rows.column("norm")))
                    continue
                sides = sides or [_by_id(x) for x in parts]
                if all(sides):
                    yield from _cosines(rows.column("a"), rows.column("b"), *sides)

    types = dict(pairs.dtypes)
    return rows.mapInArrow(run, f"a {kind}, b {kind}, cosine double").select(F.col("a").cast(types["a"]).alias("a"), F.col("b").cast(types["b"]).alias("b"), "cosine")


def _joined_cosines(vectors: DataFrame, pairs: DataFrame, id_col: str, column: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))
    v = vectors.select(id_col, F.transform(column, lambda x: x.cast("double")).alias(column)) \
        .withColumn("_l", norm).select(F.col(id_col).alias("a"), F.transform(column, lambda x: x / F.when(F.col("_l") > 0, F.col("_l"))).alias("va"))
    j = pairs.join(v, "a").join(v.select(F.col("a").alias("b"), F.col("va").alias("vb")), "b")
    return j.select("a", "b", F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("cosine"))


def _unit_rows(ids: pa.Array, vec: pa.Array, norm: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, matrix of the vectors over their lengths); the size is -1 where a vector has no length or a gap."""
    off = vec.offsets.to_numpy()
    size = np.diff(off)
    flat = vec.values.slice(off[0], off[-1] - off[0])
    gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    length = norm.fill_null(0.0).to_numpy(zero_copy_only=False)
    good = ~vec.is_null().to_numpy(zero_copy_only=False) & (gaps[off[1:] - off[0]] == gaps[off[:-1] - off[0]]) & ((size == 0) | (length != 0))
    x = np.zeros((len(size), int(size.max(initial=0))))
    at = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)
    x[at] = flat.to_numpy(zero_copy_only=False).astype(float)
    x[~good] = 0
    return ids.to_numpy(zero_copy_only=False), np.where(good, size, -1), x / np.where(length != 0, length, 1.0)[:, None]


def _by_id(parts: list[tuple]) -> tuple | None:
    """The parts of a block as one, by rising id."""
    if not parts:
        return None
    ids, size = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    wide = max(p[2].shape[1] for p in parts)
    x = np.concatenate([np.pad(p[2], ((0, 0), (0, wide - p[2].shape[1]))) for p in parts])
    order = np.argsort(ids, kind="stable")
    return ids[order], size[order], x[order]


def _cosines(a: pa.Array, b: pa.Array, left: tuple, right: tuple, chunk: int = 16_384):
    """Batches (a, b, cosine) of pairs; an id that several vectors have gives a row for each."""
    lo, hi = zip(*[[np.searchsorted(s[0], c.to_numpy(zero_copy_only=False), where) for where in ("left", "right")] for c, s in ((a, left), (b, right))])
    na, nb = hi[0] - lo[0], hi[1] - lo[1]
    upto = np.cumsum(na * nb)
    wide = min(left[2].shape[1], right[2].shape[1])
    for first in range(0, int(upto[-1]), chunk):
        k = np.arange(first, min(first + chunk, int(upto[-1])))
        r = np.searchsorted(upto, k, "right")
        k -= upto[r] - na[r] * nb[r]
        x, y = lo[0][r] + k // nb[r], lo[1][r] + k % nb[r]
        # a running sum adds number by number, so the result is the same at any size of a chunk
        dot = np.cumsum(left[2][x, :wide] * right[2][y, :wide], axis=1)[:, -1] if wide else np.zeros(len(r))
        none = (left[1][x] != right[1][y]) | (left[1][x] < 0)
        yield pa.RecordBatch.from_arrays([a.take(pa.array(r)), b.take(pa.array(r)), pa.array(dot, mask=none)], ["a", "b", "cosine"])


def _tiles(df: DataFrame, prefix: str, tile: int, fields: tuple[str, ...] = ("id", "vec")) -> DataFrame:
    """Vectors of a cell in tiles of about ``tile`` rows, however large the cell is."""
    n = df.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("_n"))
    s = df.join(n, "cell").withColumn("_t", F.pmod(F.xxhash64("id"), F.col("_n")))
    return s.groupBy("cell", "_t").agg(F.collect_list(F.struct(*fields)).alias(prefix)).select("cell", prefix)


def _squared_distances(x, y):
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def _within(x, y, radius, bound):
    """Places (row, column) where the ball of ``radius`` around y comes within ``bound`` of x."""
    slack = SLACK * (np.sqrt((x * x).sum(1))[:, None] + np.sqrt((y * y).sum(1))[None, :])
    return np.nonzero(np.sqrt(_squared_distances(x, y)) - radius[None, :] <= bound[:, None] + slack)


def _field(rows, name):
    return np.array([r[name] for r in rows], dtype=float if name != "id" else None)


def _nearest_in_cells(queries: DataFrame, members: DataFrame, k: int, tile: int, own: bool = False) -> DataFrame:
    """(id, other, distance): for each query its k nearest members of each cell it visits, tile by tile; those with the id ``own`` of the query
    only if ``own`` is set."""
    pairs = _tiles(queries, "q", tile, ("id", "vec") if own else ("id", "own", "vec")).join(_tiles(members, "m", tile), "cell").select("q", "m")

    def search(batches):
        for pdf in batches:
            for q, m in zip(pdf["q"], pdf["m"]):
                qi, mi = _field(q, "id"), _field(m, "id")
                x, y = _field(q, "vec"), _field(m, "vec")
                d2 = _squared_distances(x, y)
                if not own:
                    d2[np.array([r["own"] for r in q])[:, None] == mi[None, :]] = np.inf
                n = min(k + SPARES, d2.shape[1])  # a few spares, so that ties at the cut are settled by exact distances
                idx = np.argpartition(d2, n - 1, axis=1)[:, :n]
                rows = np.repeat(np.arange(len(qi)), n)
                cols = idx.ravel()
                keep = np.isfinite(d2[rows, cols])
                rows, cols = rows[keep], cols[keep]
                exact = np.sqrt(((x[rows] - y[cols]) ** 2).sum(1))
                yield pd.DataFrame({"id": qi[rows], "other": mi[cols], "distance": exact})

    return pairs.mapInPandas(search, "id bigint, other bigint, distance double")


def _pivot_tree(v: DataFrame, cell: int, tile: int) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(members, nearby leaves, pivots, centres) of a tree of two levels.

    Of n vectors, about sqrt(n / ``cell``) are centres, one for each top cell; the driver holds these alone.  Inside a top cell one
    vector in ``cell``, and the centre, is the pivot of a leaf, so leaves keep their size as n grows.  Nearby leaves are the NEAR
    leaves of the own top cell with the nearest pivots.  Choices go by hashes of the ids.  Members have a ``row`` of their own, as ids may repeat.
    """
    n = v.select("id").count()
    top = math.ceil(math.sqrt(max(n, 1) / cell))
    chosen = v.orderBy(F.xxhash64("id"), "id").limit(top).collect()
    centres = np.array([r["vec"] for r in chosen])

    def assign(batches):
        for pdf in batches:
            d = _squared_distances(np.array(pdf["vec"].tolist(), dtype=float), centres)
            yield pdf.assign(cell=d.argmin(1), d_top=np.sqrt(d.min(1)))

    a = v.mapInPandas(assign, "id bigint, vec array<double>, cell bigint, d_top double")
    a = cut_lineage(a.withColumn("row", F.monotonically_increasing_id()))
    own = v.sparkSession.createDataFrame([(i, r["id"], r["vec"]) for i, r in enumerate(chosen)], "cell bigint, id bigint, vec array<double>")
    sampled = a.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(cell)) == 0).select("cell", "id", "vec")
    pivots = sampled.unionByName(own).dropDuplicates(["cell", "id"])
    close = _nearest_in_cells(a.select(F.col("row").alias("id"), "vec", "cell"), pivots, NEAR, tile, own=True).withColumnRenamed("id", "row")
    near = cut_lineage(top_n(close, ["row"], [F.asc("distance"), F.asc("other")], NEAR).select("row", F.col("other").alias("pivot"), "rank"))
    leaf = near.filter("rank = 1").select("row", "pivot")
    return a.withColumnRenamed("cell", "top").join(leaf, "row"), near.select("row", "pivot"), pivots.withColumnRenamed("cell", "top"), centres


def knn_graph(df: DataFrame, id_col: str, column: str, k: int, cell: int = CELL, tile: int = TILE, portions: int = PORTIONS) -> DataFrame:
    """(id, other, distance, rank): exact k nearest neighbours by Euclidean distance; ``id_col`` is distinct.

    Vectors lie in the leaves of a pivot tree of two levels.  The k-th distance inside a few nearby leaves bounds the search: a top
    cell is sent to a portion of the vectors only if the triangle inequality allows a closer member for one of them, and streams past
    the portion leaf by leaf.  The number of portions does not grow with the table (up to PORTION_BYTES of vectors in each), and a
    vector's neighbours leave its task once, so the shuffled volume grows with the table even where no cell is ruled out.
    """
    numbers = dict(df.dtypes)[column] if dict(df.dtypes)[column] == "array<float>" else "array<double>"
    v = df.select(F.col(id_col).cast("bigint").alias("id"), F.transform(column, lambda x: x.cast("double")).alias("vec")).filter("id is not null and vec is not null")
    # a vector with a gap has no distance to any other
    v = v.filter(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    tree, near, _, centres = _pivot_tree(v, cell, tile)
    if not len(centres):
        return v.sparkSession.createDataFrame([], "id bigint, other bigint, distance double, rank int")
    tree = cut_lineage(tree)
    # a pivot may serve two top cells, if it is the centre of one and lies in the other
    leaf = F.struct("top", "pivot")
    visited = tree.select("row", "id", "vec", "top").join(near, "row").select(F.col("row").alias("id"), F.col("id").alias("own"), "vec", leaf.alias("cell"))
    inside = _nearest_in_cells(visited, tree.select("id", "vec", leaf.alias("cell")), k, tile)
    # with fewer than k neighbours in these leaves there is no bound yet
    bound = top_n(inside, ["id"], [F.asc("distance"), F.asc("other")], k).groupBy(F.col("id").alias("row")).agg(F.count("*").alias("_c"), F.max("distance").alias("_b"))
    # as many rows as there are centres
    tops = sorted(tree.groupBy("top").agg(F.count("*").alias("n"), F.max("d_top").alias("r")).collect(), key=lambda r: r["top"])
    reach, size = np.full(len(centres), -np.inf), np.zeros(len(centres))
    for r in tops:
        reach[r["top"]], size[r["top"]] = r["r"], r["n"]
    n = size.sum()
    parts = int(max(min(portions, math.ceil(4 * n / cell)), math.ceil(n * centres.shape[1] * 8 / PORTION_BYTES), 1))
    # portions are stretches of the vectors in the order of their top cells, so that most of them lie in one cell or two
    share = ((F.pmod(F.xxhash64("row"), F.lit(1 << 20)) + 0.5) / (1 << 20) * F.get("_size", F.col("top").cast("int")) + F.get("_start", F.col("top").cast("int"))) * (parts / n)
    sizes = {"_size": F.array(*map(F.lit, size.tolist())), "_start": F.array(*map(F.lit, (np.cumsum(size) - size).tolist()))}
    portion = F.least(F.floor(share), F.lit(parts - 1)).cast("int")
    # a row of an id that n rows have asks n times, so the id lists a neighbour n squared times
    repeated = tree.groupBy("id").agg(F.count("*").cast("int").alias("_m")).filter("_m > 1")
    asked = tree.join(repeated, "id", "left").withColumn("_i", F.explode(F.sequence(F.lit(1), F.coalesce("_m", F.lit(1)))))
    asking = asked.join(bound, "row", "left").withColumns(sizes).select(portion.alias("portion"), "top", "pivot", "id", "vec", F.when(F.col("_c") >= k, F.col("_b")).otherwise(float("inf")).alias("bound"))
    asking = cut_lineage(asking)

    def reached(batches):
        for pdf in batches:
            rows, cols = _within(np.array(pdf["vec"].tolist(), dtype=float), centres, reach, pdf["bound"].to_numpy())
            yield pd.DataFrame({"portion": pdf["portion"].to_numpy()[rows], "top": cols}).drop_duplicates()

    # at most one row for a portion and a centre
    sent = asking.select("portion", "vec", "bound").mapInPandas(reached, "portion int, top bigint").distinct()
    vec = F.col("vec").cast(numbers).alias("vec")
    members = tree.select("top", "pivot", "id", vec).join(F.broadcast(sent), "top").select("portion", F.lit(1).alias("side"), "top", "pivot", "id", vec, F.lit(None).cast("double").alias("bound"))
    rows = asking.select("portion", F.lit(0).alias("side"), "top", "pivot", "id", vec, "bound").unionByName(members)
    rows = rows.repartitionById(parts, F.col("portion")).sortWithinPartitions("portion", "side", "top", "pivot").select("portion", "side", "id", "vec", "bound")

    def search(batches):
        current, waiting, scan = None, [], None
        for batch in batches:
            at = batch.column("portion").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
            cuts = (np.flatnonzero(np.diff(at)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
                if lo == hi:
                    continue
                if at[lo] // 2 != current:
                    if scan:
                        yield from scan.batches()
                    current, waiting, scan = at[lo] // 2, [], None
                part = batch.slice(lo, hi - lo)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("vec"))
                if at[lo] % 2 == 0:
                    waiting.append((ids, x, part.column("bound").to_numpy()))
                    continue
                scan = scan or _Scan(*(np.concatenate(c) for c in zip(*waiting)), k)
                for first in range(0, len(ids), SCAN_MEMBERS):
                    scan.add(ids[first:first + SCAN_MEMBERS], x[first:first + SCAN_MEMBERS])
        if scan:
            yield from scan.batches()

    found = rows.mapInArrow(search, "id bigint, other bigint, distance double")
    return top_n(found, ["id"], [F.asc(F.round("distance", 9)), F.asc("other")], k)


def _matrix(vec: pa.Array) -> np.ndarray:
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(vec), -1)


class _Scan:
    """The nearest members of a portion's vectors, while members stream past: of each vector the first by (rounded distance, id)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.x, self.bound, self.k = ids, x, bound.copy(), k
        self.length2 = (x * x).sum(1)
        self.kept, self.waiting, self.rows = self._none(), [], 0
        # rounded distance and id of the last one kept, once there are k and the spares
        self.last, self.last_id = np.full(len(ids), np.inf), np.zeros(len(ids), dtype=np.int64)

    @staticmethod
    def _none():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, float, float))

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        centre = y.mean(0)
        length2 = (y * y).sum(1)
        # distances by products are exact to SLACK of the lengths, and equal when rounded up to 1e-9
        slack = SLACK * (np.sqrt(self.length2) + math.sqrt(length2.max())) + 2e-9
        radius = math.sqrt(((y - centre) ** 2).sum(1).max())
        to_centre = np.sqrt(np.maximum(self.length2 - 2 * self.x @ centre + centre @ centre, 0))
        near = np.flatnonzero(to_centre - radius <= self.bound + slack)
        right = np.vstack([y.T, np.ones(len(y)), length2])
        for open_, step in ((near[np.isinf(self.bound[near])], SCAN_OPEN), (near[np.isfinite(self.bound[near])], SCAN_ROWS)):
            for first in range(0, len(open_), step):
                at = open_[first:first + step]
                # the squared distance less the squared bound, as one product
                left = np.hstack([-2 * self.x[at], (self.length2[at] - (self.bound[at] + slack[at]) ** 2)[:, None], np.ones((len(at), 1))])
                r, c = np.nonzero(left @ right <= 0)
                self._keep(at[r], ids, y, c)

    def _keep(self, rows, ids, y, cols) -> None:
        for first in range(0, len(rows), SCAN_EXACT):
            r, c = rows[first:first + SCAN_EXACT], cols[first:first + SCAN_EXACT]
            d = np.sqrt(((self.x[r] - y[c]) ** 2).sum(1))
            rounded, other = np.floor(d * 1e9 + 0.5), ids[c]
            good = (self.ids[r] != other) & (d <= self.bound[r] + 2e-9)
            good &= (rounded < self.last[r]) | ((rounded == self.last[r]) & (other < self.last_id[r]))
            self.waiting.append((r[good], other[good], d[good], rounded[good]))
            self.rows += int(good.sum())
            if self.rows > SCAN_WAITING or np.isinf(self.bound[r]).any():
                self._settle()

    def _settle(self) -> None:
        r, other, d, rounded = (np.concatenate(c) for c in zip(self.kept, *self.waiting))
        self.waiting, self.rows = [], 0
        order = np.lexsort((other, rounded, r))
        r, other, d, rounded = r[order], other[order], d[order], rounded[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        self.kept = r, other, d, rounded = tuple(c[place < self.k + SPARES] for c in (r, other, d, rounded))
        place = place[place < self.k + SPARES]
        at = place == self.k - 1
        self.bound[r[at]] = np.minimum(self.bound[r[at]], d[at] + 1e-9)
        at = place == self.k + SPARES - 1
        self.last[r[at]], self.last_id[r[at]] = rounded[at], other[at]

    def batches(self, size: int = 100_000):
        self._settle()
        r, other, d, _ = self.kept
        for first in range(0, len(r), size):
            part = slice(first, first + size)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[r[part]]), pa.array(other[part]), pa.array(d[part])], ["id", "other", "distance"])


def grid_bins(df: DataFrame, x: str, y: str, size: int) -> DataFrame:
    """1-based bins of a size x size grid spanning the coordinates; the largest value falls in the last bin."""
    box = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    def bin_of(c, lo, hi):
        w = (F.col(hi) - F.col(lo)) / size
        return F.least(F.floor((F.col(c) - F.col(lo)) / F.when(w > 0, w)) + 1, F.lit(size)).cast("bigint")
    j = df.join(F.broadcast(box), F.lit(True))
    return j.withColumns({"bin_x": bin_of(x, "_x0", "_x1"), "bin_y": bin_of(y, "_y0", "_y1")}).drop("_x0", "_x1", "_y0", "_y1")


def grid_counts(binned: DataFrame) -> DataFrame:
    return binned.groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))


def grid_representative(binned: DataFrame, id_col: str) -> DataFrame:
    """First member of every occupied bin."""
    return best_row(binned, ["bin_x", "bin_y"], [F.col(id_col)], [id_col])


def cluster_order(df: DataFrame, id_col: str, column: str, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster, position): k-means groups by falling mean, members by falling mean, then id."""
    mean = F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(column)
    c = cut_lineage(kmeans(df, column, k, seed).select(id_col, "cluster", mean.alias("mean")))
    groups = c.groupBy("cluster").agg(F.avg("mean").alias("_g"), F.count("*").alias("_n"))
    # one row per k-means group: k rows
    order = groups.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(F.desc("_g"), "cluster").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    r = grouped_ranks(c.withColumn("_o", -F.col("mean")), ["cluster"], "_o", [id_col], out="_r")
    return r.join(order.select("cluster", "_before"), "cluster").select(id_col, "cluster", "mean", (F.col("_before") + F.col("_r")).alias("position"))


def param_grid(vectors: DataFrame, pairs: DataFrame, id_col: str, factors: list[float], components: list[int]) -> DataFrame:
    """(factor, components, a, b, cosine): similarity of chosen pairs for every setting of the grid.

    Per factor, values within factor x mean absolute deviation of their dimension's median are zeroed;
    the projections of one factor share that table.
    """
    from functools import reduce
    from .ranking import grouped_quantiles
    long = vectors.select(id_col, F.posexplode("vec").alias("dim", "v"))
    med = grouped_quantiles(long, ["dim"], "v", {"_m": 0.5})
    centred = cut_lineage(long.join(med, "dim").select(id_col, "dim", (F.col("v") - F.col("_m")).alias("v")))
    avg = centred.groupBy("dim").agg(F.avg("v").alias("_a"))
    mad = centred.join(avg, "dim").groupBy("dim").agg(F.avg(F.abs(F.col("v") - F.col("_a"))).alias("_d"))
    parts = []
    for f in factors:
        cut = centred.join(mad, "dim").withColumn("v", F.when(F.col("v") > f * F.col("_d"), F.col("v")).otherwise(0.0))
        wide = cut_lineage(cut.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("vec")))
        for c in components:
            p = pca(wide, "vec", c).select(id_col, "pcs")
            parts.append(cosine_pairs(p, pairs, id_col, "pcs").withColumns({"factor": F.lit(float(f)), "components": F.lit(c)}))
    return reduce(DataFrame.unionByName, parts)
