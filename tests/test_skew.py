"""Groups that hold most of the rows: the split paths must give the same answer as brute force."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation, functions as F

from atlas_spark.operators import entities as E, ml, network as N, quant as Q, ranking as R, relational as L, stats as S
from atlas_spark.operators.linalg import gram


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.4, "hot", np.char.add("g", rng.integers(0, 40, n).astype(str)))
    # ties, negative values and a far outlier
    v = np.round(rng.normal(0, 10, n), 1)
    v[0] = 1e9
    return pd.DataFrame({"g": g, "id": np.arange(n), "v": v})


@pytest.mark.parametrize("hot_rows", [10, 10 ** 9])
def test_ranks(spark, skewed, hot_rows):
    got = R.grouped_ranks(spark.createDataFrame(skewed), ["g"], "v", ["id"], hot_rows=hot_rows).toPandas().sort_values("id")
    want = skewed.sort_values(["g", "v", "id"]).groupby("g").cumcount().sort_index() + 1
    assert got["rank"].tolist() == want.tolist()


@pytest.mark.parametrize("hot_rows", [10, 10 ** 9])
def test_quantiles(spark, skewed, hot_rows):
    probs = {"q0": 0.0, "q2": 0.02, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = R.grouped_quantiles(spark.createDataFrame(skewed), ["g"], "v", probs, hot_rows=hot_rows).toPandas().set_index("g").sort_index()
    want = skewed.groupby("g")["v"].quantile(list(probs.values())).unstack()
    assert np.allclose(got[list(probs)].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("hot_rows", [10, 10 ** 9])
def test_global_quantile_and_running_sum(spark, skewed, hot_rows):
    df = spark.createDataFrame(skewed)
    assert R.grouped_quantiles(df, [], "v", {"m": 0.5}, hot_rows=hot_rows).first()["m"] == pytest.approx(skewed["v"].median())
    got = R.running_sum(df.withColumn("one", F.lit(2)), ["g"], "id", "one", hot_rows=hot_rows).toPandas().sort_values("id")
    assert got["running"].tolist() == ((skewed.groupby("g").cumcount() + 1) * 2).tolist()


def test_second_neighbors_with_hub(spark):
    rng = np.random.default_rng(5)
    rows = {("hub", f"p{i}") for i in range(120)} | {(f"t{rng.integers(0, 25)}", f"p{rng.integers(0, 120)}") for _ in range(700)}
    e = pd.DataFrame(sorted(rows), columns=["target", "prey"])
    got = {(r["prot_1"], r["prot_2"]) for r in N.second_neighbors(spark.createDataFrame(e)).collect()}
    by = e.groupby("prey")["target"].apply(set)
    preys = sorted(by.index)
    want = {(a, b) for i, a in enumerate(preys) for b in preys[i + 1:] if len(by[a] & by[b]) >= 3}
    assert got == want and len(want) > 50


def test_expanded_coverage_with_hub(spark):
    rng = np.random.default_rng(7)
    genes = [f"g{i}" for i in range(40)]
    pick = lambda: genes[0] if rng.random() < 0.33 else genes[rng.integers(0, 40)]
    edges = {(pick(), pick()) for _ in range(200)}
    pairs = {tuple(sorted((pick(), pick()))) for _ in range(200)}
    pairs = {(a, b) for a, b in pairs if a != b}
    targets = {t for t, _ in edges}
    both = pairs | {(b, a) for a, b in pairs}
    direct = {(a, b) for a, b in both if (a, b) in edges}
    cover = {p for p in both if p in direct or any((p[0], c) in direct and c in targets and (c, p[1]) in edges for c in genes)}
    want = len({tuple(sorted(p)) for p in cover}), len({p for p in pairs if p[0] in targets or p[1] in targets})
    df = lambda s, names: spark.createDataFrame(pd.DataFrame(sorted(s), columns=names))
    r = N.coverage_expanded(df(edges, ["target", "prey"]), df(pairs, ["prot_1", "prot_2"])).first()
    assert (r["covered"], r["possible"]) == want


def test_contains_join(spark):
    texts = pd.DataFrame({"t": ["ABCD", "BCA", "XYZ", "A"]})
    needles = pd.DataFrame({"n": ["A", "BC", "YZ", "Q"]})
    got = {(r["t"], r["n"]) for r in L.contains_join(spark.createDataFrame(texts), "t", spark.createDataFrame(needles), "n").collect()}
    assert got == {(t, n) for t in texts["t"] for n in needles["n"] if n in t}


def test_leave_out_scores_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(f"p{p}", f"b{b}", r, float(np.round(rng.normal(20 + (p == b), 1), 3))) for p in range(6) for b in range(7) for r in range(3) if rng.random() > 0.1]
    v = pd.DataFrame(rows, columns=["prey", "bait", "replicate", "value"])
    excl = {f"b{b}": {f"b{b}", f"b{(b + 1) % 7}"} for b in range(7)}
    x = spark.createDataFrame([(a, o) for a, s in excl.items() for o in s], "bait string, other string")
    df = spark.createDataFrame(v)
    got = {(r["prey"], r["bait"]): r for r in S.leave_out_scores(df, df, x).collect()}
    for (prey, bait), g in v.groupby(["prey", "bait"]):
        con = v[(v.prey == prey) & ~v.bait.isin(excl[bait])]["value"].to_numpy()
        a = g["value"].to_numpy()
        dof = len(a) + len(con) - 2
        sp = (((a - a.mean()) ** 2).sum() + ((con - con.mean()) ** 2).sum()) / dof
        t = (a.mean() - con.mean()) / np.sqrt(sp * (1 / len(a) + 1 / len(con)))
        r = got[prey, bait]
        assert r["t"] == pytest.approx(t) and r["df"] == dof
        assert r["enrichment"] == pytest.approx((np.median(a) - np.median(con)) / con.std(ddof=1))


def test_sample_stats_hold_no_lists(spark):
    rows = [("p", f"b{b}", r, float((7 * r + 3 * b) % 11)) for b in range(4) for r in range(b + 1)] + [("p", "b0", 9, None), ("q", "b0", 0, None)]
    got = S.sample_stats(spark.createDataFrame(rows, "prey string, bait string, replicate int, value double"))
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(f"b{b}", float(np.median([v for _, x, _, v in rows if x == f"b{b}" and v is not None]))) for b in range(4)}
    assert {(r["bait"], r["med1"]) for r in got.collect()} == want


def test_fractions_of_own_values_only(monkeypatch):
    """Each value's fraction is computed on one side only, and its company does not change it."""
    from atlas_spark.functions import pvalue
    t, df = np.array([0.1, 1.0, 3.0, 40.0, -2.0, 1e-9]), np.array([3.0, 30.0, 5.0, 12.0, 300.0, 4.0])
    sizes, plain = [], pvalue._fraction
    monkeypatch.setattr(pvalue, "_fraction", lambda a, b, x: sizes.append(len(x)) or plain(a, b, x))
    together = pvalue.neglog10p_array(t, df)
    assert sum(sizes) == len(t)
    assert together.tolist() == [pvalue.neglog10p_array(t[i:i + 1], df[i:i + 1])[0] for i in range(len(t))]


def test_second_neighbors_without_lists(spark):
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame(sorted({(f"t{rng.integers(9)}", f"p{rng.integers(12)}") for _ in range(60)}), "target string, prey string")
    pairs, listed = N.second_neighbors(edges, listed=False), N.second_neighbors(edges)
    assert "collect_list" not in pairs._jdf.queryExecution().executedPlan().toString()
    want = sorted((r["prot_1"], r["prot_2"]) for r in listed.collect())
    assert want and sorted(map(tuple, pairs.collect())) == want


def nearest(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("cell", [16, 1024])
def test_knn_with_hot_cell(spark, cell):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.01, (150, 6)), rng.normal(0, 5, (140, 6)), np.ones((10, 6))])
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    got = ml.knn_graph(df, "id", "vec", 5, cell=cell, tile=32).toPandas()
    assert len(got) == 1500 and not got.duplicated(["id", "other"]).any()
    have = got.sort_values(["id", "rank"])["distance"].to_numpy().reshape(300, 5)
    assert np.allclose(have, nearest(x, 5))


@pytest.mark.parametrize("portions", [1, 7])
def test_knn_of_copies(spark, portions):
    """Of more copies than are wanted the smallest ids stay, however the vectors are dealt."""
    rng = np.random.default_rng(9)
    ids = rng.permutation(120).tolist()
    x = np.vstack([np.ones((60, 3)), rng.normal(0, 1, (60, 3))])
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in zip(ids, x)], "id bigint, vec array<double>")
    got = {(r["id"], r["rank"]): (r["other"], r["distance"]) for r in ml.knn_graph(df, "id", "vec", 5, cell=16, tile=32, portions=portions).collect()}
    for i in set(ids):
        d = sorted((round(float(np.sqrt(((x[a] - x[b]) ** 2).sum())), 9), ids[b]) for a in range(120) for b in range(120) if ids[a] == i != ids[b])[:5]
        assert [got[i, n + 1][0] for n in range(5)] == [o for _, o in d]
        assert np.allclose([got[i, n + 1][1] for n in range(5)], [v for v, _ in d], atol=1e-8)


def test_leaves_keep_their_size(spark):
    rng = np.random.default_rng(4)
    sizes = []
    for n in (400, 4000):
        v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(rng.normal(0, 1, (n, 4)))], "id bigint, vec array<double>")
        tree, _, pivots, centres = ml._pivot_tree(v, 20, 256)
        assert len(centres) == int(np.ceil(np.sqrt(n / 20))) and tree.count() == n
        sizes.append(n / tree.select("top", "pivot").distinct().count())
    assert 8 < sizes[0] < 32 and 8 < sizes[1] < 32


def test_knn_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, None)], "id bigint, vec array<double>")
    assert [(r["id"], r["other"], r["rank"]) for r in ml.knn_graph(df, "id", "vec", 3).orderBy("id").collect()] == [(1, 2, 1), (2, 1, 1)]
    assert ml.knn_graph(df.limit(0), "id", "vec", 3).isEmpty()


def test_partition_count_does_not_matter(spark, tables):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = Q.impute_prey(tables.sql("select prey, bait, replicate, log2(value) as value from {intensity}"), threshold=20)
            out.append(sorted((r["prey"], r["bait"], r["replicate"], round(r["value"], 8) if r["value"] is not None else None) for r in df.collect()))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_null_key_of_a_large_group(spark):
    """A NULL group gives the same rows on both sides of the limit."""
    from atlas_spark.operators import ranking
    df = spark.createDataFrame([(None if i % 2 else "a", i, float(i % 7)) for i in range(43)], "k string, i bigint, v double")
    for fn in (lambda n: ranking.grouped_ranks(df, ["k"], "i", hot_rows=n), lambda n: ranking.running_sum(df, ["k"], "i", "v", hot_rows=n),
               lambda n: ranking.grouped_quantiles(df, ["k"], "i", {"q": 0.3}, hot_rows=n)):
        small, large = (sorted(map(tuple, fn(n).collect()), key=str) for n in (500_000, 5))
        assert small == large and any(r[0] is None for r in small)


def test_unsettled_loops_raise(spark):
    import pytest
    from atlas_spark.operators import network, relational
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "line_id bigint, parent_id bigint")
    assert {r.root for r in relational.lineage_root(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        relational.lineage_root(chain, max_rounds=2)
    path = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(12)], "target string, prey string")
    with pytest.raises(RuntimeError):
        network.prune_single_edges(path, max_rounds=0)


def test_local_folder_needs_a_local_master():
    import pytest
    from atlas_spark.session import own_folder
    assert own_folder("local[8]", "atlas-test-") and own_folder("local", "atlas-test-")
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            own_folder(master, "atlas-test-")


def exchanges(plan):
    """Column types that each shuffle or broadcast of a physical plan carries."""
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "Exchange" in node.nodeName():
            out.append(node.schema().simpleString())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_scores_shuffle_no_lists(spark, tables):
    v = tables.complete
    x = spark.createDataFrame([(f"B{i}", f"B{j}") for i in range(12) for j in (i, (i + 1) % 12)], "bait string, other string")
    ranks = S.ranked_control(v)
    for df in (ranks, S.removed_values(ranks, x.withColumnRenamed("bait", "set_id"), True), S.leave_out_scores(v, v, x), S.leave_out_scores(v, v, None)):
        carried = exchanges(df._jdf.queryExecution().executedPlan())
        assert not any("array<" in c for c in carried), carried
    assert exchanges(S.leave_out_scores(v, v, x)._jdf.queryExecution().executedPlan())


def test_scores_of_a_large_prey(spark):
    """A prey with more values than a window should sort is ranked in pieces, with the same scores; ties and excluded middles included."""
    rng = np.random.default_rng(8)
    rows = [("hot" if p == 0 else f"p{p}", f"b{b}", r, float(rng.integers(0, 9))) for p in range(3) for b in range(40 if p == 0 else 6) for r in range(3)]
    df = spark.createDataFrame(rows, "prey string, bait string, replicate int, value double")
    x = spark.createDataFrame([(f"b{i}", f"b{j}") for i in range(40) for j in range(40) if i % 5 == j % 5], "bait string, other string")
    ranked = [sorted((r["prey"], r["rank"], r["value"]) for r in S.ranked_control(df, n).collect()) for n in (10, 10 ** 6)]
    assert ranked[0] == ranked[1] and len(ranked[0]) == len(rows)
    v = pd.DataFrame(rows, columns=["prey", "bait", "replicate", "value"])
    for r in S.leave_out_scores(df, df, x, ddof=0).collect():
        con = v[(v.prey == r["prey"]) & (v.bait.str[1:].astype(int) % 5 != int(r["bait"][1:]) % 5)]["value"]
        own = v[(v.prey == r["prey"]) & (v.bait == r["bait"])]["value"]
        assert r["n2"] == len(con) and r["enrichment"] == pytest.approx((own.median() - con.median()) / con.std(ddof=0))


def test_contains_join_of_any_length(spark):
    """Rows are linear in the text, whatever the needles' lengths; equal answers with a plain search."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcé"), rng.integers(0, 12))) for _ in range(80)] + ["ab" * 2000, "", None, "abc", "abc"]
    needles = ["".join(rng.choice(list("abcé"), rng.integers(1, 6))) for _ in range(60)] + ["", None, "ab" * 1500, "zz", "a", "a"]
    rows = list(enumerate(texts))
    got = L.contains_join(spark.createDataFrame(rows, "id int, t string"), "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    want = sorted((i, n) for i, t in rows for n in {x for x in needles if x} if t and n in t)
    assert sorted((r["id"], r["n"]) for r in got.collect()) == want


def test_text_ranks_cut_long_common_starts(spark):
    """Names that agree in their first forty characters fall into many pieces."""
    rng = np.random.default_rng(6)
    names = [f"{'x' * 40}{i:07d}" for i in rng.permutation(4000)] + ["a", "zé", "", "x"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    seen = []
    original = R.cut_lineage
    R.cut_lineage = lambda d: seen.append(original(d)) or seen[-1]
    try:
        got = {r["name"]: r["rank"] for r in R.text_ranks(df, "name").collect()}
    finally:
        R.cut_lineage = original
    assert got == {n: i for i, n in enumerate(sorted(names), 1)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in df.repartitionByRange("name").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 3 * 4004 / 8


def test_member_pairs_spread_a_hub(spark):
    """One group holds half of the rows: its pairs come from many keys, each with a few blocks' members, and none is lost or doubled."""
    rows = [("hub", f"p{i:03d}") for i in range(200)] + [(f"t{i % 40}", f"p{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "target string, prey string")
    got = [(r["first"], r["second"]) for r in N.member_pairs(df, "target", "prey", block=20).collect()]
    assert len(got) == len(set(got)) == 200 * 199 // 2 and all(a < b for a, b in got)
    plan = N.second_neighbors(df)._jdf.queryExecution().executedPlan()
    assert not any("array<string>" in c for c in exchanges(plan))  # no list of targets travels with a candidate


def plain_mcl(adjacency, inflation=2.0, prune=0.001):
    m = adjacency / adjacency.sum(0)
    while True:
        n = (m @ m) ** inflation
        n /= n.sum(0)
        n = np.where((n >= prune) | (n == n.max(0)), n, 0)
        if np.allclose(n, m):
            return n
        m = n


def test_mcl_equals_matrix_iteration(spark):
    rng = np.random.default_rng(11)
    n = 40
    group = np.arange(n) // 10
    adjacency = np.triu(rng.random((n, n)) < np.where(np.equal.outer(group, group), 0.7, 0.04), 1)
    names = [f"g{i:02}" for i in range(n)]
    edges = spark.createDataFrame([(names[i], names[j]) for i, j in zip(*np.nonzero(adjacency))], "target string, prey string")
    got = N.mcl_clusters(spark.createDataFrame([("C", g) for g in names], "cluster_id string, gene string"), edges, first_thresh=3, mcl_thresh=1)
    m = plain_mcl((adjacency | adjacency.T | np.eye(n, dtype=bool)).astype(float))
    centres = [i for i in range(n) if m[i, i] > 0]
    want = {names[j]: names[min(i for i in centres if m[i, j] > 0)] for j in range(n)}
    assert {r["gene"]: r["cluster"] for r in got.collect()} == want and len(set(want.values())) > 2


def test_mcl_rounds_start_from_few_rows_of_a_star(spark):
    leaves = [f"leaf{i:03}" for i in range(300)]
    edges = spark.createDataFrame([("hub", x) for x in leaves], "target string, prey string")
    members = spark.createDataFrame([("C", g) for g in ["hub", *leaves]], "cluster_id string, gene string")
    got = N.mcl_clusters(members, edges, first_thresh=3, mcl_thresh=1, select=8)
    assert {(r["cluster"], r["gene"]) for r in got.collect()} == {("hub", g) for g in ["hub", *leaves]}
    m = N.both_ways(edges.select(F.lit("C").alias("cluster_id"), F.col("target").alias("i"), F.col("prey").alias("j"), F.lit(1.0).alias("v")), "i", "j")
    first = N._columns_to_one(m, 1.0, 0.0, 8)
    assert first.groupBy("j").count().agg(F.max("count")).first()[0] == 8
    blocked, whole = ({(r["i"], r["j"]): r["v"] for r in N._squared(first, b).collect()} for b in (16, 10 ** 6))
    assert blocked.keys() == whole.keys() and all(blocked[k] == pytest.approx(whole[k]) for k in whole)


@pytest.mark.parametrize("size", [(512, 256), (7, 3)])
def test_products_do_not_depend_on_tiles(spark, size):
    rng = np.random.default_rng(13)
    cells = pd.DataFrame([(f"r{i}", f"c{j:02}", float(rng.normal())) for i in range(60) for j in range(12) if rng.random() < 0.5 and j != 11 or i == 0], columns=["r", "c", "v"])
    rows = [tuple(x) for x in cells.itertuples(index=False)] + [("r1", "c11", None), (None, "c00", 1.0), ("r2", None, 1.0)]
    got = gram(spark.createDataFrame(rows, "r string, c string, v double"), "r", "c", "v", *size).toPandas()
    wide = cells.pivot(index="r", columns="c", values="v")
    shared = wide.notna().astype(int).T @ wide.notna().astype(int)
    want = wide.fillna(0).T @ wide.fillna(0)
    assert len(got) == int((shared.to_numpy() > 0).sum())
    assert all(want.loc[a, b] == pytest.approx(d) for a, b, d in got[["a", "b", "dot"]].itertuples(index=False))


def test_products_of_an_empty_table(spark):
    assert gram(spark.createDataFrame([], "r bigint, c bigint, v double"), "r", "c", "v").isEmpty()


# --- vectors and tiles that many rows name ---------------------------------------------------------

def test_cluster_tiles_are_summed_before_they_meet_pulldowns(spark):
    """One cluster of 3000 tiles in 3000 pulldowns: 9 million joined rows, were the tiles joined one by one."""
    heat = spark.range(3000).select(F.col("id").alias("hit_id"), F.lit(7).cast("bigint").alias("cluster_id"), (F.col("id") % 9).alias("row_index"), (F.col("id") % 5).alias("col_index"))
    hits = spark.range(3000).select(F.col("id").alias("hit_id"), F.col("id").alias("pulldown_id"))
    measures = [F.count("*").alias("n_tiles"), F.count_distinct("row_index").alias("n_rows"), F.count_distinct("col_index").alias("n_cols")]
    seen = Observation()
    out = E.pulldown_cluster_tiles(heat, hits, measures).observe(seen, F.count("*").alias("n"))
    assert out.drop("pulldown_id").distinct().collect() == [(7, 3000, 9, 5)] and seen.get["n"] == 3000
    few = E.pulldown_cluster_tiles(heat.limit(4), hits)
    assert few.count() == 16


def test_every_tile_meets_every_pulldown_of_its_cluster(spark, monkeypatch):
    """Measures see the rows of pulldown and tile, and portions of a cluster's pulldowns lose no row; nulls meet nothing."""
    tiles = [(i, i % 3 if i % 10 else None, i % 7, i % 4) for i in range(60)] + [(5, 2, 5, 1), (None, 0, 1, 1)]
    seen = [(i, i % 11 if i != 8 else None) for i in range(60)] + [(5, 5), (6, 3)]
    heat = spark.createDataFrame(tiles, "hit_id bigint, cluster_id bigint, row_index bigint, col_index bigint")
    hits = spark.createDataFrame(seen, "hit_id bigint, pulldown_id bigint")
    least = {}
    for h, p in seen:
        for i, c, _, _ in tiles:
            if i == h and c is not None:
                least[p] = min(least.get(p, c), c)
    want = sorted(((p, c, *t) for p, c in least.items() for t in ((i, r, k) for i, d, r, k in tiles if d == c)), key=str)
    for portion in (4096, 1):
        monkeypatch.setattr(E, "PORTION", portion)
        got = E.pulldown_cluster_tiles(heat, hits).select("pulldown_id", "cluster_id", "hit_id", "row_index", "col_index")
        assert sorted(map(tuple, got.collect()), key=str) == want
        close = F.count_if(F.col("row_index") == F.col("pulldown_id")).alias("close")  # of a pulldown and a tile together
        per = E.pulldown_cluster_tiles(heat, hits, [F.count("*").alias("n"), close]).collect()
        assert {r["pulldown_id"]: (r["cluster_id"], r["n"], r["close"]) for r in per} == {
            p: (c, sum(x[0] == p for x in want), sum(x[0] == p == x[3] for x in want)) for p, c in least.items()}


def plain_cosine(x, y):
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return None
    lx, ly = (sum(v * v for v in z) ** 0.5 for z in (x, y))
    return sum(p * q for p, q in zip(x, y)) / (lx * ly) if lx and ly else (0.0 if not x else None)


def test_cosine_of_listed_pairs_with_odd_vectors(spark):
    vecs = [(1, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [3.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (7, []), (None, [1.0, 1.0])]
    pairs = [(a, b) for a in [*range(1, 9), None] for b in [*range(1, 9), None]] + [(1, 2)]
    v = spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>")
    p = spark.createDataFrame(pairs, "a int, b bigint")
    wanted = sorted(((a, b, plain_cosine(x, y)) for a, b in pairs for i, x in vecs for j, y in vecs if a is not None and b is not None and a == i and b == j), key=str)
    for least, size, short in ((1, 1 << 20, 0), (16, 64, 0), (3, 1 << 20, 0), (3, 1 << 20, 8)):
        got = ml.cosine_pairs(v, p, "vec_id", "embedding", size, least, short)
        assert dict(got.dtypes) == {"a": "int", "b": "bigint", "cosine": "double"}
        rows = sorted(map(tuple, got.collect()), key=str)
        assert [r[:2] for r in sorted(rows, key=lambda r: r[:2])] == sorted(w[:2] for w in wanted)
        key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0.0)
        for r, w in zip(sorted(rows, key=key), sorted(wanted, key=key)):
            assert (r[2] is None) == (w[2] is None) and (r[2] is None or abs(r[2] - w[2]) < 1e-6)


def test_vectors_are_not_copied_for_every_pair(spark):
    """60 vectors in 40000 pairs: rows with a vector are shuffled per tile, pairs as ids alone."""
    v = spark.range(60).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(i)) + F.col("id") for i in range(1, 9)]).alias("embedding"))
    p = spark.range(40000).select((F.col("id") % 60).alias("a"), F.floor(F.col("id") / 60).cast("bigint").alias("b")).withColumn("b", F.col("b") % 60)
    out = ml.cosine_pairs(v, p, "vec_id", "embedding", least=4, short=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "RepartitionByExpression [i#" in plan and out.count() == 40000
    both = [line for line in plan.splitlines() if "Join " in line and re.search(r"\ba#", line)]
    assert not both  # vectors meet (tile, id), never a pair


def test_set_edges_are_dealt_by_their_number(spark, monkeypatch):
    """Narrow rows that compress to little are dealt by count, so a task does not take them all; nulls meet nothing."""
    rng = np.random.default_rng(8)
    edges = {(f"G{a}", f"G{b}") for a, b in rng.integers(0, 60, (900, 2))} | {(None, "G1"), ("G1", None)}
    sets = {(f"S{s}", f"G{g}") for s, g in zip(rng.integers(0, 9, 200), rng.integers(0, 60, 200))} | {(None, "G1"), ("S1", None)}
    of = {}
    for s, g in sets:
        of.setdefault(g, set()).add(s)
    want = {(a, b) for a, b in edges if None not in (a, b) and of.get(a, set()) & of.get(b, set()) - {None}}
    monkeypatch.setattr(N, "TASK_ROWS", 100)
    got = N.shared_set_edges(spark.createDataFrame(list(edges), "target string, prey string"), spark.createDataFrame(list(sets), "set_id string, gene string"))
    dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", got._jdf.queryExecution().optimizedPlan().toString())]
    assert len(dealt) == 8 and min(dealt) > 5
    assert {tuple(r) for r in got.collect()} == want


def test_reference_pairs_are_covered_once(spark):
    """Both recall columns come from one stored pass over the reference pairs."""
    scores = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 3.0), ("c", "d", 1.5), ("b", "a", 0.5)], "target string, prey string, lv double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "d"), ("c", "x")], "prot_1 string, prot_2 string")
    loc = spark.createDataFrame([("a", "N"), ("b", "N/C"), ("c", "O"), ("d", "O")], "gene string, label string")
    pr = N.precision_recall(scores, F.col("lv"), pairs, loc, [0, 1, 2])
    assert "prot_2" not in pr.select("threshold", "recall")._jdf.queryExecution().optimizedPlan().toString()
    assert {r["threshold"]: (r["num_interactions"], round(r["recall"], 6)) for r in pr.collect()} == {0.0: (4, round(1 / 3, 6)), 1.0: (3, round(1 / 3, 6)), 2.0: (1, 0.0)}


def plain_recall(scores, pairs, at):
    """(hits, recall) by the rule itself: pairs that a target touches, and of them those covered by an edge or by way of a covered target."""
    hits = {(t, p) for t, p, v in scores if v is not None and v > at}
    targets = {t for t, _ in hits if t is not None}
    covered = lambda a, b: a is not None and b is not None and (a, b) in hits
    possible = {p for p in pairs if targets & set(p)}
    listed = {x for p in pairs for x in (p, p[::-1])}
    by_way = lambda a, b: any(c in targets and (a, c) in listed and covered(a, c) and covered(c, b) for c in targets)
    got = {p for p in possible if any(covered(*x) or None not in x and by_way(*x) for x in (p, p[::-1]))}
    return sum(v is not None and v > at for _, _, v in scores), len(got) / len(possible) if possible else None


def test_recall_of_odd_rows(spark, monkeypatch):
    """Nulls, self pairs, pairs listed both ways and repeated rows, against the rule itself; also with rows dealt by their number."""
    rng = np.random.default_rng(21)
    name = lambda i: f"G{i}" if i else None
    scores = [(name(a), name(b), float(v)) for a, b, v in zip(rng.integers(0, 9, 90), rng.integers(0, 16, 90), rng.integers(0, 5, 90))] + [("G1", "G2", None)]
    pairs = list({(name(a), name(b)) for a, b in rng.integers(0, 16, (70, 2))} | {("G1", "G2"), ("G2", "G1"), ("G3", "G3"), ("G1", "G3")})
    loc = spark.createDataFrame([(f"G{i}", "N/C" if i % 2 else "O") for i in range(1, 16)], "gene string, label string")
    for rows in (200_000, 1):
        monkeypatch.setattr(N, "TASK_ROWS", rows)
        pr = N.precision_recall(spark.createDataFrame(scores, "target string, prey string, lv double"), F.col("lv"), spark.createDataFrame(pairs, "prot_1 string, prot_2 string"), loc, [3, 0, 1.5, 2])
        for r in pr.collect():
            n, recall = plain_recall(scores, pairs, r["threshold"])
            assert r["num_interactions"] == n and r["recall"] == pytest.approx(recall)


def test_only_preys_that_are_targets_lead_on(spark, monkeypatch):
    """A target with 50 covered preys, of which one is a target; pairs that no way can raise are not asked for."""
    asked = {}

    def seen(pairs, left, l, right, r, x, task_rows=None, real=N.intersect_lists):
        asked.update(pairs=pairs.count(), left=left.count())
        return real(pairs, left, l, right, r, x, task_rows)
    monkeypatch.setattr(N, "intersect_lists", seen)
    edges = spark.createDataFrame([("a", f"p{i}", 2.0) for i in range(50)] + [("p7", "z", 1.0)], "target string, prey string, lv double")
    pairs = spark.createDataFrame([("a", f"p{i}") for i in range(50)] + [("a", "z")], "prot_1 string, prot_2 string")
    got = {(r["a"], r["b"]): (r["possible"], r["covered"]) for r in N.expanded_coverage(edges, pairs, "lv").collect()}
    assert asked == {"pairs": 2, "left": 1}  # a-z and p7-a
    assert got == {**{("a", f"p{i}"): (2.0, 2.0) for i in range(50)}, ("a", "z"): (2.0, 1.0), ("p7", "a"): (1.0, None)}


def test_bait_match_adds_up_chosen_preys_only(spark, monkeypatch):
    """The rows of the chosen preys are taken below the total they come from; more keys than are broadcast are hashed, with the same result."""
    from atlas_spark.operators import quant, relational
    rows = [(f"G{b}", r, f"P{p}", float(b + p + r)) for b in range(6) for r in range(2) for p in range(8)] + [(None, 0, "P1", 1.0), ("G1", 0, None, 99.0)]
    names = spark.createDataFrame([("P1", "G1"), ("P7", "G1"), ("P2", "G2;G3"), ("P3", "G30;G3"), (None, "G4")], "prey string, gene_names string")
    raw = spark.createDataFrame(rows + rows, "bait_gene string, replicate int, prey string, value double")
    df = raw.groupBy("bait_gene", "replicate", "prey").agg(F.max("value").alias("value"))
    for few in (100_000, 0):
        monkeypatch.setattr(relational, "FEW_KEYS", few)
        got = quant.bait_match(df, names)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftSemi") > plan.rindex("Aggregate [") if few else "shuffle_hash" in plan, plan
        assert {(r["bait_gene"], r["replicate"], r["intensity"], r["exact"]) for r in got.collect()} == {
            (f"G{b}", r, float(b + p + r), exact) for b, p, exact in ((1, 7, True), (2, 2, False), (3, 2, False)) for r in (0, 1)}


def test_distinct_rows_are_dealt_by_their_number(spark):
    rows = [(i % 70, i % 30 if i % 9 else None) for i in range(3000)]
    got = L.distinct_rows(spark.createDataFrame(rows, "a bigint, b bigint"), task_rows=100)
    assert got.rdd.getNumPartitions() == 30 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, set(rows)))
    assert L.distinct_rows(spark.createDataFrame([], "a bigint")).count() == 0
