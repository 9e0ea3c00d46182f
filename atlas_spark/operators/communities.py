"""Communities by leading eigenvectors of the modularity matrix, split until no split raises the modularity.

The open communities form a work list.  One of up to LOCAL_NODES nodes is worked to the end in one task, on dense matrices
of that size.  A larger one that falls into many connected pieces is worked in one task as well, up to SPARSE_NODES nodes: it
holds one dense matrix per piece, and the part of the modularity matrix that joins the pieces has rank one.  All others
advance together by a Lanczos iteration whose products are joins and sums, until they are closed or small.  All ways take
the same vector: the start vector's part in the leading eigenspace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keyed
from ..session import cut_lineage
from .network import both_ways, induced_subgraph

#: Nodes of a community that one task may hold as dense matrices (8 MB each).
LOCAL_NODES = 1024
#: Nodes of a community in pieces and sum of their degrees that one task may hold, and numbers in the matrices of its pieces (64 MB).
SPARSE_NODES = 65_536
SPARSE_DEGREES = 1_000_000
SPARSE_NUMBERS = 8_000_000
#: Vectors of one Lanczos run, runs before the work gives up, and the residual (of the largest eigenvalue) that ends it.
KRYLOV = 12
MAX_RUNS = 200
TOLERANCE = 1e-6
#: A split must raise the modularity (times twice the edges) by more than this; smaller parts of a vector count as 0.
GAIN = 1e-9
ZERO = 1e-5
MAX_LEVELS = 10_000

KEY = ["cluster_id", "comm"]


def modularity_split(membership: DataFrame, edges: DataFrame, first_thresh: int, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(super_cluster, second_clustering, cluster, gene): clusters of ``first_thresh`` members and three inner edges or more are split into
    communities, named by the path of their splits; the others come as they are, with a NULL cluster.

    Members of a split cluster without an inner edge are in no community.  Raises where a vector is not settled after
    MAX_RUNS runs or a community after MAX_LEVELS levels, rather than end early.
    """
    size = membership.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    sized = membership.join(size, "cluster_id")
    inner = induced_subgraph(edges, sized)
    links = inner.groupBy("cluster_id").agg(F.count("*").alias("_e"))
    big = sized.join(links, "cluster_id", "left").withColumn("big", (F.col("_n") >= first_thresh) & (F.coalesce("_e", F.lit(0)) >= 3))
    chosen = big.filter("big").select("cluster_id").distinct()
    adj = cut_lineage(both_ways(inner.join(chosen, "cluster_id", "left_semi").select(
        "cluster_id", F.least("target", "prey").alias("a"), F.greatest("target", "prey").alias("b")).distinct(), "a", "b"))
    degree = adj.groupBy("cluster_id", F.col("a").alias("gene")).agg(F.count("*").alias("k"))
    twice = degree.groupBy("cluster_id").agg(F.sum("k").alias("m2"))
    start = keyed.uniform(F.col("cluster_id").cast("string"), "gene") - 0.5
    nodes = cut_lineage(degree.join(twice, "cluster_id").select("cluster_id", F.lit("0").alias("comm"), "gene", "k", "m2", start.alias("x")))

    found = []
    for _ in range(MAX_LEVELS):
        of = nodes.groupBy(*KEY).agg(F.count("*").alias("_n"), F.sum("k").alias("_k"))
        small = nodes.join(of.filter(F.col("_n") <= local_nodes).select(*KEY), KEY, "left_semi")
        found.append(_split_small(small, adj))
        held = (F.col("_n") <= SPARSE_NODES) & (F.col("_k") <= SPARSE_DEGREES)
        pieces = nodes.join(of.filter((F.col("_n") > local_nodes) & held).select(*KEY), KEY, "left_semi")
        split = cut_lineage(_split_sparse(pieces, adj, local_nodes))
        found.append(split.filter("not open").drop("open"))
        left = split.filter("open").withColumnRenamed("comm", "_comm").drop("open")
        left = pieces.join(left, ["cluster_id", "gene"]).select("cluster_id", F.col("_comm").alias("comm"), "gene", "k", "m2", "x")
        nodes = cut_lineage(left.unionByName(nodes.join(of.filter((F.col("_n") > local_nodes) & ~held).select(*KEY), KEY, "left_semi")))
        if nodes.isEmpty():
            break
        closed, nodes = _split_large(nodes, adj)
        found.append(closed)
    else:
        raise RuntimeError(f"communities still open after {MAX_LEVELS} levels")
    split = found[0]
    for more in found[1:]:
        split = split.unionByName(more)
    out = split.select(F.col("cluster_id").alias("super_cluster"), F.lit(True).alias("second_clustering"), F.col("comm").alias("cluster"), "gene")
    rest = big.filter("not big").select(F.col("cluster_id").alias("super_cluster"), F.lit(False).alias("second_clustering"), F.lit(None).cast("string").alias("cluster"), "gene")
    return out.unionByName(rest)


# --- communities that fit one task ---------------------------------------------------------------

def leading(matrix: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray]:
    """(largest eigenvalue, unit vector): the part of ``start`` in the space of the largest eigenvalue."""
    values, axes = np.linalg.eigh(matrix)
    top = axes[:, values >= values[-1] - 1e-8 * max(1.0, abs(values[-1]))]
    x = top @ (top.T @ start)
    length = np.linalg.norm(x)
    return float(values[-1]), x / length if length > 1e-12 else top[:, 0]


def split_to_the_end(adjacency: np.ndarray, k: np.ndarray, m2: float, start: np.ndarray, name: str) -> list[str]:
    """Names of the final communities of one open community's nodes; degrees and edges are those of the whole graph."""
    names = [""] * len(k)
    work = [(name, np.arange(len(k)))]
    while work:
        label, at = work.pop()
        b = adjacency[np.ix_(at, at)] - np.outer(k[at], k[at]) / m2
        b -= np.diag(b.sum(axis=1))
        value, x = leading(b, start[at]) if len(at) > 1 else (0.0, np.ones(1))
        side = np.where(x >= -ZERO, 1.0, -1.0)
        if value > GAIN and len(set(side)) > 1 and side @ b @ side > GAIN:
            work += [(f"{label}.1", at[side > 0]), (f"{label}.2", at[side < 0])]
        else:
            for i in at.tolist():
                names[i] = label
    return names


def _with_neighbours(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """nodes with the list ``near`` of their neighbours in the same community."""
    label = nodes.select(*KEY, "gene")
    within = (adj.join(label.withColumnRenamed("gene", "a"), ["cluster_id", "a"])
              .join(label.withColumnRenamed("gene", "b"), ["cluster_id", "b", "comm"]).groupBy("cluster_id", "comm", "a").agg(F.collect_list("b").alias("near")))
    return nodes.join(within.withColumnRenamed("a", "gene"), [*KEY, "gene"], "left")


def _split_small(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(cluster_id, comm, gene): a group is one community of bounded size with its edges."""
    rows = _with_neighbours(nodes, adj)

    def run(table: pa.Table) -> pa.Table:
        genes = table.column("gene").to_pylist()
        index = {g: i for i, g in enumerate(genes)}
        adjacency = np.zeros((len(genes), len(genes)))
        for i, near in enumerate(table.column("near").to_pylist()):
            adjacency[i, [index[g] for g in near or ()]] = 1.0
        k, m2, start = (table.column(c).to_numpy() for c in ("k", "m2", "x"))
        names = split_to_the_end(adjacency, k.astype(float), float(m2[0]), start, table.column("comm")[0].as_py())
        return pa.table([table.column("cluster_id"), pa.array(names), table.column("gene")], ["cluster_id", "comm", "gene"])
    kinds = dict(nodes.dtypes)
    return rows.groupBy(*KEY).applyInArrow(run, f"cluster_id {kinds['cluster_id']}, comm string, gene {kinds['gene']}")


# --- communities in many pieces ------------------------------------------------------------------

def connected(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges (u, v), which are listed in both directions."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, root, low.copy())
        low = low[low]
        if (low == root).all():
            return root
        root = low


def piece_matrices(n: int, u: np.ndarray, v: np.ndarray, largest: int) -> list[np.ndarray] | None:
    """Places of the pieces' nodes, one array (pieces, nodes) per size of a piece; None where a task could not hold their matrices."""
    root = connected(n, u, v)
    size = np.bincount(root, minlength=n)
    if size.max(initial=0) > largest or (size.astype(float) ** 2).sum() > SPARSE_NUMBERS:
        return None
    order = np.lexsort((np.arange(n), root, size[root]))
    of = size[root][order]
    return [order[of == s].reshape(-1, s) for s in np.unique(of)]


def leading_in_pieces(pieces: list[np.ndarray], u: np.ndarray, v: np.ndarray, k: np.ndarray, d: np.ndarray, m2: float, start: np.ndarray) -> tuple[float, np.ndarray]:
    """As ``leading``, of the matrix that has the edges, less ``d`` on its diagonal, less k k' / m2.

    Without the last term the matrix has one block per piece.  In the eigenvectors of the blocks it is diagonal less a product of
    one vector with itself: an eigenvalue that several of them share stays one, for the vectors without a part in k; otherwise the
    largest one is the root of the secular equation between the two largest.
    """
    at, place = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    kind = np.zeros(len(k), np.int64)
    for g, nodes in enumerate(pieces):
        kind[nodes], at[nodes], place[nodes] = g, np.arange(len(nodes))[:, None], np.arange(nodes.shape[1])[None, :]
    values, z, w, axes = [], [], [], []
    for g, nodes in enumerate(pieces):
        m = np.zeros((len(nodes), nodes.shape[1], nodes.shape[1]))
        mine = kind[u] == g
        m[at[u[mine]], place[u[mine]], place[v[mine]]] = 1.0
        diagonal = np.arange(nodes.shape[1])
        m[:, diagonal, diagonal] -= d[nodes]
        value, axis = np.linalg.eigh(m)
        values.append(value.ravel())
        z.append((k[nodes][:, None, :] @ axis).ravel())
        w.append((start[nodes][:, None, :] @ axis).ravel())
        axes.append(axis)
    values, z, w = np.concatenate(values), np.concatenate(z), np.concatenate(w)

    def shared(top: float) -> tuple[np.ndarray, np.ndarray]:
        """Where values count as the largest one, and the part of z there (0 where it would move none of them)."""
        there = values >= top - 1e-8 * max(1.0, abs(top))
        part = np.where(there, z, 0.0)
        return there, part if part @ part / m2 > 1e-8 * max(1.0, abs(top)) else np.zeros(len(part))

    top = float(values.max())
    there, part = shared(top)
    if there.sum() == 1 and part.any() and len(values) > 1:
        low, high = float(values[~there].max()), top
        lo, hi = low, high
        for _ in range(200):
            mid = (lo + hi) / 2
            if not lo < mid < hi:
                break
            lo, hi = (mid, hi) if (z * z / (values - mid)).sum() < m2 else (lo, mid)
        root = (lo + hi) / 2
        near = values >= low - 1e-8 * max(1.0, abs(low))
        if root - low > 1e-8 * max(1.0, abs(low)):
            mix = z / (values - root)
            mix /= np.linalg.norm(mix)
            return root, _mixed(pieces, axes, mix * (1.0 if mix @ w >= 0 else -1.0))
        # the second largest value has no part in k, so it stands and the largest one falls below it
        there, part, top = near & ~there, np.zeros(len(z)), low
    elif there.sum() == 1 and part.any():
        top -= float(part @ part) / m2
        part = np.zeros(len(z))
    mix = np.where(there, w, 0.0)
    if part.any():
        mix -= part * (part @ mix) / (part @ part)
    if np.linalg.norm(mix) <= 1e-12:
        first = np.flatnonzero(there)
        mix = np.where(np.arange(len(z)) == first[0], 1.0, 0.0)
        if part.any():
            mix -= part * (part @ mix) / (part @ part)
        if np.linalg.norm(mix) <= 1e-9:
            mix = np.where(np.arange(len(z)) == first[-1], 1.0, 0.0)
    return top, _mixed(pieces, axes, mix / np.linalg.norm(mix))


def _mixed(pieces: list[np.ndarray], axes: list[np.ndarray], mix: np.ndarray) -> np.ndarray:
    """The vector with the coordinates ``mix`` in the eigenvectors of the pieces."""
    x, first = np.zeros(len(mix)), 0
    for nodes, axis in zip(pieces, axes):
        c = mix[first:first + nodes.size].reshape(nodes.shape)
        x[nodes] = (axis @ c[:, :, None])[:, :, 0]
        first += nodes.size
    return x


def split_pieces(u: np.ndarray, v: np.ndarray, k: np.ndarray, m2: float, start: np.ndarray, name: str, largest: int) -> tuple[list[str], np.ndarray]:
    """Names of one community's final communities, and which nodes are in one that is still open as a piece of it is too large."""
    names, left = [""] * len(k), np.zeros(len(k), bool)
    work = [(name, np.arange(len(k)), u, v)]
    here = np.zeros(len(k), np.int64)
    while work:
        label, nodes, a, b = work.pop()
        here[nodes] = np.arange(len(nodes))
        x, y, ks = here[a], here[b], k[nodes]
        pieces = piece_matrices(len(nodes), x, y, largest)
        if pieces is not None and len(nodes) > 1:
            d = np.bincount(x, minlength=len(nodes)) - ks * (ks.sum() / m2)
            value, lead = leading_in_pieces(pieces, x, y, ks, d, m2, start[nodes])
            side = np.where(lead >= -ZERO, 1.0, -1.0)
            gain = (side[x] * side[y]).sum() - d.sum() - (ks @ side) ** 2 / m2
            if value > GAIN and len(set(side.tolist())) > 1 and gain > GAIN:
                for end, keep in ((".1", side > 0), (".2", side < 0)):
                    both = keep[x] & keep[y]
                    work.append((label + end, nodes[keep], a[both], b[both]))
                continue
        left[nodes] = pieces is None
        for i in nodes.tolist():
            names[i] = label
    return names, left


def _split_sparse(nodes: DataFrame, adj: DataFrame, largest: int) -> DataFrame:
    """(cluster_id, comm, gene, open): a group is one community of up to SPARSE_NODES nodes with its edges; an open one has a piece of
    more than ``largest`` nodes and was split no further."""
    def run(table: pa.Table) -> pa.Table:
        genes = table.column("gene").to_pylist()
        index = {g: i for i, g in enumerate(genes)}
        near = [[index[g] for g in row or ()] for row in table.column("near").to_pylist()]
        u = np.repeat(np.arange(len(genes)), [len(row) for row in near])
        v = np.array([i for row in near for i in row], np.int64)
        k, m2, start = (table.column(c).to_numpy() for c in ("k", "m2", "x"))
        names, left = split_pieces(u, v, k.astype(float), float(m2[0]), start, table.column("comm")[0].as_py(), largest)
        return pa.table([table.column("cluster_id"), pa.array(names), table.column("gene"), pa.array(left)], ["cluster_id", "comm", "gene", "open"])
    kinds = dict(nodes.dtypes)
    # few rows, but long work on each group: a number of partitions given here is not drawn together
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _with_neighbours(nodes, adj).repartition(tasks, *KEY)
    return rows.groupBy(*KEY).applyInArrow(run, f"cluster_id {kinds['cluster_id']}, comm string, gene {kinds['gene']}, open boolean")


# --- larger communities --------------------------------------------------------------------------

def _split_large(nodes: DataFrame, adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed(cluster_id, comm, gene), open nodes): one split of every community by its leading vector."""
    label = nodes.select(*KEY, "gene")
    within = cut_lineage(adj.join(label.withColumnRenamed("gene", "a"), ["cluster_id", "a"])
                         .join(label.withColumnRenamed("gene", "b"), ["cluster_id", "b", "comm"]).select(*KEY, "a", "b"))
    kin = within.groupBy(*KEY, F.col("a").alias("gene")).agg(F.count("*").alias("kin"))
    total = nodes.groupBy(*KEY).agg(F.sum("k").alias("kg"))
    # row sums of the community's modularity matrix are taken off its diagonal
    st = nodes.join(kin, [*KEY, "gene"], "left").na.fill(0, ["kin"]).join(total, KEY)
    st = cut_lineage(st.select(*KEY, "gene", "k", "m2", (F.col("kin") - F.col("k") * F.col("kg") / F.col("m2")).alias("d"), "x"))
    vectors = _leading_vectors(st, within)
    signed = cut_lineage(vectors.withColumn("v", F.when(F.col("v") >= -ZERO, 1.0).otherwise(-1.0)))
    gain = _product(signed, within, "v").groupBy(*KEY).agg(F.sum(F.col("v") * F.col("w")).alias("gain"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("value").alias("value"))
    good = gain.filter((F.col("gain") > GAIN) & (F.col("value") > GAIN) & (F.col("lo") < F.col("hi"))).select(*KEY, F.lit(True).alias("split"))
    done = cut_lineage(signed.join(good, KEY, "left").select(*KEY, "gene", "k", "m2", "x", "split", F.when(F.col("v") > 0, ".1").otherwise(".2").alias("side")))
    closed = done.filter("split is null").select(*KEY, "gene")
    still = done.filter("split").select("cluster_id", F.concat("comm", "side").alias("comm"), "gene", "k", "m2", "x")
    return closed, still


def _product(x: DataFrame, within: DataFrame, column: str | Column) -> DataFrame:
    """x with ``w``: the community's modularity matrix times a column of x."""
    c = F.col(column) if isinstance(column, str) else column
    x = x.withColumn("_c", c)
    ax = within.join(x.select(*KEY, F.col("gene").alias("b"), "_c"), [*KEY, "b"]).groupBy(*KEY, F.col("a").alias("gene")).agg(F.sum("_c").alias("_ax"))
    dot = x.groupBy(*KEY).agg(F.sum(F.col("k") * F.col("_c")).alias("_kx"))
    j = x.join(ax, [*KEY, "gene"], "left").join(dot, KEY)
    return j.withColumn("w", F.coalesce("_ax", F.lit(0.0)) - F.col("k") * F.col("_kx") / F.col("m2") - F.col("d") * F.col("_c")).drop("_c", "_ax", "_kx")


def _unit(x: DataFrame, column: str, length: DataFrame | None = None) -> DataFrame:
    """x with the column divided by its length in each community; a zero vector stays."""
    length = length if length is not None else x.groupBy(*KEY).agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("_len"))
    return x.join(length, KEY).withColumn(column, F.when(F.col("_len") > 0, F.col(column) / F.col("_len")).otherwise(0.0)).drop("_len")


def _leading_vectors(st: DataFrame, within: DataFrame) -> DataFrame:
    """st with ``v`` (leading vector, from the start ``x``) and ``value`` (its eigenvalue), by restarted Lanczos runs.

    Communities whose residual is small enough are set aside after each run.
    """
    parts = []
    live = cut_lineage(_unit(st.withColumn("v", F.col("x")), "v"))
    for _ in range(MAX_RUNS):
        basis, projected = _krylov(live, within)
        ritz = _ritz(projected)
        mixed = F.aggregate(F.zip_with("q", "mix", lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + F.coalesce(y, F.lit(0.0)))
        nxt = cut_lineage(_unit(basis.join(ritz, KEY).withColumn("v", mixed).drop("q", "mix"), "v"))
        parts.append(nxt.filter("settled").drop("settled"))
        live = nxt.filter("not settled").drop("settled", "value")
        if live.isEmpty():
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
    raise RuntimeError(f"leading vectors not settled after {MAX_RUNS} runs")


def _krylov(live: DataFrame, within: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their row ``q`` of the orthonormal base, projected(key, step, h, rest)): every new vector is made orthogonal to
    all before it; ``rest`` is the length of what is left of it.  One job and one checkpoint per vector."""
    cur = live.withColumn("q", F.array("v")).drop("v")
    rows = []
    for step in range(KRYLOV):
        w = cut_lineage(_product(cur, within, F.element_at("q", step + 1)))
        part = [F.sum(F.element_at("q", i + 1) * F.col("w")) for i in range(step + 1)]
        sums = w.groupBy(*KEY).agg(F.array(*part).alias("h"), F.sum(F.col("w") * F.col("w")).alias("ww"))
        left = F.col("ww") - F.aggregate("h", F.lit(0.0), lambda acc, y: acc + y * y)
        # nothing but rounding is left where the base spans all that the start can reach
        rest = F.when(left > 1e-14 * F.greatest("ww", F.lit(1.0)), F.sqrt(F.greatest(left, F.lit(0.0)))).otherwise(0.0)
        sums = sums.select(*KEY, F.lit(step).alias("step"), "h", rest.alias("rest"))
        rows.append(sums)
        less = F.aggregate(F.zip_with("q", "h", lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y)
        following = F.when(F.col("rest") > 0, (F.col("w") - less) / F.col("rest")).otherwise(0.0)
        cur = w.join(sums.drop("step"), KEY).withColumn("q", F.concat("q", F.array(following)) if step + 1 < KRYLOV else F.col("q")).drop("w", "h", "rest")
    projected = rows[0]
    for r in rows[1:]:
        projected = projected.unionByName(r)
    return cur, projected


def _ritz(projected: DataFrame) -> DataFrame:
    """(key, mix, value, settled): the leading vector of each community's small projected matrix (KRYLOV squared numbers)."""
    one = projected.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("step", "h", "rest"))).alias("s"))
    kind = dict(projected.dtypes)["cluster_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixes, values, settled = [], [], []
            for s in batch.column("s").to_pylist():
                stop = next((r["step"] + 1 for r in s if r["rest"] == 0), len(s))
                m = np.zeros((stop, stop))
                for r in s[:stop]:
                    m[:len(r["h"]), r["step"]] = r["h"]
                m = np.triu(m) + np.triu(m, 1).T
                value, axes = np.linalg.eigh(m)
                mix = axes[:, -1] * (1 if axes[0, -1] >= 0 else -1)
                rest = s[stop - 1]["rest"] * abs(mix[-1])
                mixes.append([*mix.tolist(), *[0.0] * (KRYLOV - stop)])
                values.append(float(value[-1]))
                settled.append(bool(rest <= TOLERANCE * max(1.0, np.abs(value).max())))
            yield pa.RecordBatch.from_arrays([batch.column("cluster_id"), batch.column("comm"), pa.array(mixes, pa.list_(pa.float64())), pa.array(values, pa.float64()),
                                              pa.array(settled, pa.bool_())], ["cluster_id", "comm", "mix", "value", "settled"])
    return one.mapInArrow(run, f"cluster_id {kind}, comm string, mix array<double>, value double, settled boolean")
