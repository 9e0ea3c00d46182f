"""Golden cases for the scalar functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlas_spark.functions import cols as C
from atlas_spark.functions.pvalue import neglog10p_array
from atlas_spark.operators.image import autoscale


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_plate_ids(spark):
    assert column(spark, ["123", "plate123", "Plate 123", "P0123"], C.plate_id) == ["P0123"] * 4
    assert column(spark, ["", "a", "Plate  1"], C.plate_id) == [None] * 3


def test_well_ids(spark):
    assert column(spark, ["A1", "A10", "A99", "Z1"], C.well_id) == ["A01", "A10", "A99", "Z1"]


def test_sequences(spark):
    assert column(spark, ["", "a", "ACGTacgt", "acgx", "n"], C.is_sequence) == [True, True, True, False, False]


def test_ms_plate(spark):
    got = column(spark, ["9", "0009.2", "12.0", "CZBMPI_0003", "x"], C.ms_plate)
    assert got == ["CZBMPI_0009", "CZBMPI_0009.2", "CZBMPI_0012", "CZBMPI_0003", None]


def test_root_gene(spark):
    assert column(spark, ["CCT6A", "MED12", "POLR2A", "ACTB"], C.root_gene) == ["CCT", "MED", "POLR", "ACTB"]


def test_protein_names(spark):
    names = ["Atlastin-2 (EC 3.6.5.-) (ARL-6-interacting protein 2)", "Ribonucleoprotein H (hnRNP H) [Cleaved into: part]", "Plain name"]
    assert column(spark, names, C.protein_name) == ["Atlastin-2", "Ribonucleoprotein H", "Plain name"]


def test_hlog_round_trip(spark):
    got = column(spark, [-500.0, 0.0, 1.0, 2500.0, 9000.0], lambda v: F.round(C.hlog(C.hlog_inverse(v)), 5), "double")
    assert got == [-500.0, 0.0, 1.0, 2500.0, 9000.0]


# two-sided 5 % and 0.1 % points of Student's t from printed tables
@pytest.mark.parametrize("t,df,p", [(12.706, 1, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (6.869, 5, 0.001), (4.587, 10, 0.001), (3.646, 30, 0.001)])
def test_p_values(t, df, p):
    assert neglog10p_array(np.array([t]), np.array([float(df)]))[0] == pytest.approx(-np.log10(p), abs=2e-3)


def test_p_value_limits():
    got = neglog10p_array(np.array([0.0, 1e4, np.nan, 3.0]), np.array([5.0, 40.0, 5.0, 0.0]))
    # far out the tail is x^a / (a B(a, 1/2)) with x = df / (df + t^2), a = df / 2
    a, x = 20.0, 40.0 / (40.0 + 1e8)
    beta = math.exp(math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5))
    assert got[1] == pytest.approx(-(a * math.log10(x) - math.log10(a * beta)), rel=1e-6)
    assert got[0] == pytest.approx(0) and np.isnan(got[2]) and np.isnan(got[3])


@pytest.mark.parametrize("pixels,p,kind,want", [
    ([0] * 10, 0, "uint8", {0}), ([1] * 10, 0, "uint8", {0}), ([1, 11], 0, "uint8", {0, 255}), ([1, 11], 0, "uint16", {0, 65535}),
    ([1] * 5 + [5] * 85 + [6] * 10, 0, "uint8", {0, 204, 255}), ([1] * 5 + [5] * 85 + [6] * 10, 1, "uint8", {0, 204, 255}),
    ([1] * 5 + [5] * 85 + [6] * 10, 6, "uint8", {0, 255}), ([1] * 5 + [5] * 85 + [6] * 10, 11, "uint8", {0})])
def test_autoscale(spark, pixels, p, kind, want):
    df = spark.createDataFrame([(1, pixels)], "fov_id int, pixels array<int>")
    assert set(autoscale(df, ["fov_id"], p, kind).first()["pixels"]) == want
