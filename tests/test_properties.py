"""Properties of the operators that plain SQL cannot restate."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlas_spark.functions import cols as C
from atlas_spark.operators import cyto as Y, incremental as I, ml, network as N


def two_cliques(spark, size=6):
    rows = []
    for c in ("a", "b"):
        rows += [(f"{c}{i}", f"{c}{j}", 1.0) for i in range(size) for j in range(i + 1, size)]
    rows.append(("a0", "b0", 1.0))
    edges = spark.createDataFrame(rows, "target string, prey string, weight double")
    members = spark.createDataFrame([("C", f"{c}{i}") for c in "ab" for i in range(size)], "cluster_id string, gene string")
    return edges, members


def sides(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], set()).add(r["gene"][0])
    return out


def test_mcl_separates_cliques(spark):
    edges, members = two_cliques(spark)
    got = N.mcl_clusters(members, edges, first_thresh=3, mcl_thresh=2)
    assert got.count() == 12 and sorted(map(sorted, sides(got).values())) == [["a"], ["b"]]


def test_haircut_and_pruning_reach_a_fixed_point(spark):
    edges, members = two_cliques(spark)
    tail = spark.createDataFrame([("a0", "x1", 1.0), ("x1", "x2", 1.0)], edges.schema)
    more = members.unionByName(spark.createDataFrame([("C", "x1"), ("C", "x2")], members.schema))
    trimmed = N.recursive_haircut(more, edges.unionByName(tail))
    assert {r["gene"][0] for r in trimmed.collect()} == {"a", "b"}
    assert N.haircut(trimmed, edges.unionByName(tail)).count() == trimmed.count()
    p = N.prune_single_edges(edges.unionByName(tail))
    assert p.groupBy("target").count().filter("count < 2").isEmpty() and p.groupBy("prey").count().filter("count < 2").isEmpty()


def test_unmixing_recovers_offset(spark):
    rng = np.random.default_rng(0)
    # the sample's bins are about 17 wide, so the negative peak is made wider than a bin
    control = [("P", w, float(x)) for w in range(4) for x in rng.normal(120, 30, 1500)]
    sample = [("P", 9, float(x)) for x in np.concatenate([rng.normal(135, 30, 1500), rng.normal(380, 20, 1500)])]
    schema = "plate string, well int, fitc double"
    r = Y.all_plates(spark.createDataFrame(sample, schema), spark.createDataFrame(control, schema), xrange=(0, 500)).first()
    assert r["fitted_offset"] == pytest.approx(135, abs=9)
    assert r["area"] == pytest.approx(0.5, abs=0.15)
    assert r["raw_median"] == pytest.approx(380, abs=25)


def test_raw_measurements_are_transformed_and_gated(spark):
    inside, outside = (9600.0, 300.0, 8700.0), [(8000.0, 300.0, 8700.0), (9600.0, 300.0, 8400.0), (9600.0, 450.0, 8700.0), (None, 300.0, 8700.0), (9600.0, None, 8700.0)]
    values = [-200.0, 0.0, 15.5, 420.0, None]
    rows = [("P", i, v, *inside) for i, v in enumerate(values)] + [("P", 9, 100.0, *o) for o in outside]
    measured = spark.createDataFrame(rows, "plate string, well int, fitc double, fsc_a double, fsc_w double, ssc_a double")
    raw = measured.withColumns({c: C.hlog_inverse(c) for c in ("fitc", "fsc_a", "ssc_a")})
    got = sorted(((r["well"], r["fitc"]) for r in Y.transform_and_gate(raw).collect()))
    assert [w for w, _ in got] == list(range(5)) and got[4][1] is None
    assert [v for _, v in got[:4]] == pytest.approx(values[:4], abs=1e-6)
    assert Y.transform_and_gate(raw.limit(0)).isEmpty()


def test_plates_from_raw_measurements(spark):
    rng = np.random.default_rng(1)
    draw = lambda w, xs: [("P", w, float(x), 9600.0, 300.0, 8700.0) for x in xs]
    schema = "plate string, well int, fitc double, fsc_a double, fsc_w double, ssc_a double"
    control = spark.createDataFrame([r for w in range(2) for r in draw(w, rng.normal(120, 30, 800))], schema)
    sample = spark.createDataFrame(draw(9, np.concatenate([rng.normal(135, 30, 800), rng.normal(380, 20, 800)])), schema)
    debris = spark.createDataFrame([("P", 9, 250.0, 8000.0, 300.0, 8000.0)] * 500, schema)
    raw = lambda df: df.withColumns({c: C.hlog_inverse(c) for c in ("fitc", "fsc_a", "ssc_a")})
    names = ["area", "fitted_offset", "raw_mean", "raw_median"]
    got = Y.analyse_plates(raw(sample.unionByName(debris)), raw(control), (0, 500)).select(*names).first()
    want = Y.all_plates(sample, control, (0, 500)).select(*names).first()
    assert list(got) == pytest.approx(list(want), rel=1e-6)


def test_error_log_runs_each_item_once(spark):
    items = spark.range(20).withColumnRenamed("id", "fov_id")

    def task(row):
        if row["fov_id"] % 5 == 0:
            raise ValueError(f"bad {row['fov_id']}")
        return row["fov_id"] * 2
    ok, bad = I.run_with_error_log(items, "fov_id", "double", task)
    assert ok.count() == 16 and bad.count() == 4
    assert {r["error_kind"] for r in bad.collect()} == {"ValueError"}


def test_pca_components_are_ordered_and_uncorrelated(spark, tables):
    p = ml.pca(tables.embeddings, "embedding", 3).select(*[F.get("pcs", F.lit(i)).alias(f"c{i}") for i in range(3)]).toPandas()
    assert (p.var().diff().dropna() <= 1e-9).all()
    assert np.allclose(np.corrcoef(p.to_numpy().T) - np.eye(3), 0, atol=1e-6)


def test_cluster_order_is_a_permutation(spark, tables):
    o = ml.cluster_order(tables.embeddings, "vec_id", "embedding", 4).toPandas()
    assert sorted(o["position"]) == list(range(1, len(o) + 1))
    assert o.sort_values("position").groupby("cluster", sort=False)["mean"].apply(lambda m: (m.diff().dropna() <= 1e-12).all()).all()


def test_update_from_keeps_one_row_per_row(spark):
    from atlas_spark.sources.upserts import update_from
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "k int, name string, v int")
    changes = spark.createDataFrame([(1, None, 9), (1, "x", 7), (3, "y", 1), (None, "z", 5)], "k int, name string, v int")
    got = sorted(map(tuple, update_from(rows, changes, ["k"], ["name", "v"]).collect()), key=str)
    assert got == [(1, "x", 7), (2, "b", 2), (None, "c", 3)]
