"""Leading-eigenvector communities: planted groups, modularity by brute force, and the same answer in one task and in many."""

import itertools

import numpy as np
import pytest

from atlas_spark.operators import communities as C

EDGES, MEMBERS = "target string, prey string, weight double", "cluster_id string, gene string"


def planted(groups, size, inside, between, seed):
    rng = np.random.default_rng(seed)
    n = groups * size
    return [(f"{i // size}_{i % size}", f"{j // size}_{j % size}") for i in range(n) for j in range(i) if rng.random() < (inside if i // size == j // size else between)]


def tables(spark, graphs):
    pairs, members = [], []
    for cluster, edges in graphs.items():
        pairs += [(f"{cluster}{a}", f"{cluster}{b}", 1.0) for a, b in edges]
        members += [(cluster, f"{cluster}{g}") for g in {x for e in edges for x in e}]
    return spark.createDataFrame(members, MEMBERS), spark.createDataFrame(pairs, EDGES)


def communities(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["super_cluster"], r["cluster"]), set()).add(r["gene"])
    return out


def modularity(edges, groups):
    m2 = 2 * len(edges)
    degree = {}
    for a, b in edges:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    inner = sum(2 for a, b in edges for g in groups if a in g and b in g)
    return inner / m2 - sum(sum(degree[x] for x in g) ** 2 for g in groups) / m2 ** 2


def partitions(nodes):
    if not nodes:
        yield []
        return
    first, rest = nodes[0], nodes[1:]
    for p in partitions(rest):
        yield [[first], *p]
        for i in range(len(p)):
            yield [*p[:i], [first, *p[i]], *p[i + 1:]]


def test_eight_planted_communities(spark):
    """The splits go on to eight groups and more, and reach most of the planted modularity (leading vectors alone, as this method
    works, may cut a group in two on the way down)."""
    graphs = {"A": planted(8, 8, 0.9, 0.02, 1), "B": planted(8, 6, 1.0, 0.01, 2), "C": planted(8, 10, 1.0, 0.01, 3)}
    members, edges = tables(spark, graphs)
    got = communities(C.modularity_split(members, edges, first_thresh=10))
    for c, least in (("A", 0.75), ("B", 0.95), ("C", 0.95)):
        mine = [{g[len(c):] for g in v} for (s, _), v in got.items() if s == c]
        true = {}
        for g in set().union(*mine):
            true.setdefault(g.split("_")[0], set()).add(g)
        assert len(mine) >= 8 and modularity(graphs[c], mine) >= least * modularity(graphs[c], list(true.values()))


def test_many_tasks_give_the_answer_of_one(spark):
    graphs = {"E": planted(2, 10, 0.8, 0.1, 7), "F": planted(3, 6, 0.9, 0.1, 8)}
    members, edges = tables(spark, graphs)
    assert communities(C.modularity_split(members, edges, first_thresh=10, local_nodes=12)) == communities(C.modularity_split(members, edges, first_thresh=10))


def test_modularity_against_all_partitions(spark):
    rng = np.random.default_rng(5)
    graphs = {}
    for k in range(5):
        edges = [(str(i), str(j)) for i in range(8) for j in range(i) if rng.random() < (0.8 if (i < 4) == (j < 4) else 0.15)]
        graphs[f"c{k}_"] = edges
    members, df = tables(spark, graphs)
    got = communities(C.modularity_split(members, df, first_thresh=3))
    for c, edges in graphs.items():
        mine = [{g[len(c):] for g in v} for (s, _), v in got.items() if s == c]
        best = max(modularity(edges, p) for p in partitions(sorted({x for e in edges for x in e})))
        have = modularity(edges, mine)
        assert have > 0.85 * best
        # no final community gains by any split in two
        for g in mine:
            for r in range(1, len(g)):
                for part in itertools.combinations(sorted(g), r):
                    assert modularity(edges, [x for x in mine if x != g] + [set(part), g - set(part)]) <= best + 1e-12


def test_distributed_vector_is_the_dense_one(spark):
    edges = planted(3, 7, 0.8, 0.1, 9)
    members, df = tables(spark, {"D": edges})
    seen = {}
    original = C._leading_vectors

    def spy(st, within):
        out = original(st, within)
        seen.update({r["gene"]: (r["v"], r["x"], r["value"]) for r in out.collect()})
        return out
    C._leading_vectors = spy
    try:
        split = communities(C.modularity_split(members, df, first_thresh=3, local_nodes=20))
    finally:
        C._leading_vectors = original
    genes = sorted(seen)
    a = np.zeros((len(genes),) * 2)
    for x, y in edges:
        i, j = genes.index("D" + x), genes.index("D" + y)
        a[i, j] = a[j, i] = 1
    k = a.sum(axis=1)
    b = a - np.outer(k, k) / k.sum()
    value, v = C.leading(b - np.diag(b.sum(axis=1)), np.array([seen[g][1] for g in genes]))
    assert np.allclose([seen[g][0] for g in genes], v, atol=1e-5) and seen[genes[0]][2] == pytest.approx(value)
    assert split == communities(C.modularity_split(members, df, first_thresh=3))


def test_small_clusters_and_edges_without_members(spark):
    members = spark.createDataFrame([("S", "a"), ("S", "b"), ("T", "a"), ("T", "b"), ("T", "c"), ("T", "d"), ("T", "lonely"), (None, "a")], MEMBERS)
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "a", 1.0), ("c", "d", 1.0), ("x", "a", 1.0), (None, "a", 1.0), ("b", "a", 2.0)], EDGES)
    got = sorted(map(tuple, C.modularity_split(members, edges, first_thresh=3).collect()), key=str)
    assert [r for r in got if r[0] == "S"] == [("S", False, None, "a"), ("S", False, None, "b")]
    assert {r[3] for r in got if r[0] == "T"} == {"a", "b", "c", "d"} and all(r[1] for r in got if r[0] == "T")
    none = spark.createDataFrame([], MEMBERS)
    assert C.modularity_split(none, edges, first_thresh=3).count() == 0


def test_unsettled_vectors_raise(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_RUNS", 1)
    monkeypatch.setattr(C, "KRYLOV", 2)
    members, df = tables(spark, {"D": planted(3, 5, 0.8, 0.1, 3)})
    with pytest.raises(RuntimeError):
        C.modularity_split(members, df, first_thresh=3, local_nodes=5)


def star_pieces(rng, pieces):
    edges, first = [], 0
    for _ in range(pieces):
        n, kind = int(rng.integers(2, 8)), int(rng.integers(0, 3))
        if kind == 0:
            edges += [(first, first + i) for i in range(1, n)]
        elif kind == 1:
            edges += [(first + i, first + j) for i in range(n) for j in range(i) if j == i - 1 or rng.random() < 0.7]
        else:
            edges += [(first + i, first + i + 1) for i in range(n - 1)]
        first += n
    return edges, first


def test_pieces_give_the_answer_of_one_matrix():
    rng = np.random.default_rng(11)
    for trial in range(40):
        edges, n = star_pieces(rng, 2 + trial % 20)
        a = np.zeros((n, n))
        for x, y in edges:
            a[x, y] = a[y, x] = 1
        u, v = np.nonzero(a)
        k, start = a.sum(axis=1), rng.random(n) - 0.5
        names, left = C.split_pieces(u, v, k, k.sum(), start, "0", 1024)
        assert names == C.split_to_the_end(a, k, k.sum(), start, "0") and not left.any()


def test_many_pieces_need_no_round_each(spark, monkeypatch):
    """A cluster of many small pieces is above the dense limit; no split of it goes through distributed rounds."""
    edges, _ = star_pieces(np.random.default_rng(12), 25)
    members, df = tables(spark, {"M": [(str(a), str(b)) for a, b in edges]})
    want = communities(C.modularity_split(members, df, first_thresh=3))
    monkeypatch.setattr(C, "_split_large", lambda *_: pytest.fail("a distributed split"))
    assert communities(C.modularity_split(members, df, first_thresh=3, local_nodes=12)) == want
