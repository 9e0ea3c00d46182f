"""Queries for feature vectors."""

from pyspark.sql import functions as F

from ..operators import ml as M
from ..operators.relational import distinct_rows
from ..registry import query
from .relational import rounded


@query("log1p_scale", """with x as (select vec_id, dim, ln(1 + v) as v from {vectors}), s as (select dim, avg(v) as m, stddev_samp(v) as sd from x group by 1)
    select vec_id, x.dim, round(least((v - m) / sd, 10), 6) as v from x join s on s.dim = x.dim""")
def log1p_scale(t):
    return rounded(M.log1p_scale(t.vectors.select("vec_id", "dim", "v")), "v")


@query("pca")
def pca(t):
    p = M.pca(t.embeddings, "embedding", 5)
    return p.select("vec_id", *[F.round(F.abs(F.get("pcs", F.lit(i))), 6).alias(f"pc{i + 1}") for i in range(5)])


@query("kmeans")
def kmeans(t):
    return M.kmeans(t.embeddings, "embedding", 10).select("vec_id", "cluster")


VECTORS = "(select max(vec_id) + 1 from {embeddings})"
PAIRS = f"select distinct l_partkey % {VECTORS} as a, l_suppkey % {VECTORS} as b from {{lineitem}} where l_partkey % {VECTORS} <> l_suppkey % {VECTORS}"


@query("cosine_pairs", f"select a, b, round(list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])), 6) as cosine from ({PAIRS}) p join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b")
def cosine_pairs(t):
    return rounded(M.cosine_pairs(t.embeddings, t.sql(PAIRS), "vec_id", "embedding"), "cosine")


@query("knn_graph", """with d as (select a.vec_id as id, b.vec_id as other, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as distance from embeddings a join embeddings b on a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by id order by round(distance, 9), other) as rank from d) select id, other, round(distance, 6) as distance, cast(rank as int) as rank from r where rank <= 10""")
def knn_graph(t):
    return rounded(M.knn_graph(t.embeddings, "vec_id", "embedding", 10), "distance").select("id", "other", "distance", "rank")


XY = "(select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from {embeddings})"
BINS = f"(with p as {XY}, b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p) select vec_id, cast(least(floor((x - x0) / ((x1 - x0) / 20)) + 1, 20) as bigint) as bin_x, cast(least(floor((y - y0) / ((y1 - y0) / 20)) + 1, 20) as bigint) as bin_y from p, b)"


def binned(t):
    xy = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return M.grid_bins(xy, "x", "y", 20)


@query("grid_bins", f"select bin_x, bin_y, count(*) as n from {BINS} q group by 1, 2")
def grid_bins(t):
    return M.grid_counts(binned(t))


@query("grid_representative", f"select bin_x, bin_y, min(vec_id) as vec_id from {BINS} q group by 1, 2")
def grid_representative(t):
    return M.grid_representative(binned(t), "vec_id")


@query("cluster_order")
def cluster_order(t):
    return rounded(M.cluster_order(t.embeddings, "vec_id", "embedding", 8), "mean")


@query("param_grid")
def param_grid(t):
    v = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    pairs = distinct_rows(t.sql(PAIRS.replace("select distinct", "select", 1)))
    return M.param_grid(v, pairs, "vec_id", [0.5, 1.0], [2, 4]).select("factor", "components", "a", "b", F.round(F.coalesce("cosine", F.lit(0.0)), 6).alias("cosine"))
