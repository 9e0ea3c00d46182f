"""Tail probability of Student's t as -log10 p, vectorised over Arrow batches.

Spark has no incomplete beta function, so this one step runs as a pandas UDF.  Working with
logarithms keeps p values far below the smallest double.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _log_beta(df: np.ndarray) -> np.ndarray:
    uniq, inverse = np.unique(df, return_inverse=True)
    vals = np.array([math.lgamma(d / 2) + math.lgamma(0.5) - math.lgamma(d / 2 + 0.5) for d in uniq])
    return vals[inverse]


def _fraction(a, b, x, rounds: int = 300):
    """Continued fraction of the incomplete beta integral (modified Lentz steps); a value leaves the loop once it has settled."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    out, at = h.copy(), np.arange(len(x))
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        out[at] = h
        open_ = np.abs(d * c - 1.0) >= 1e-15
        if not open_.any():
            break
        if not open_.all():
            at, a, b, x, c, d, h = (z[open_] for z in (at, a, b, x, c, d, h))
    return out


def neglog10p_array(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided -log10 p of t with df degrees of freedom; NaN where undefined."""
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if not ok.any():
        return out
    t, df = t[ok].astype(float), df[ok].astype(float)
    a, b = df / 2, np.full_like(df, 0.5)
    x = df / (df + t * t)
    y = t * t / (df + t * t)
    with np.errstate(divide="ignore"):
        front = a * np.log(x) + b * np.log(y) - _log_beta(df)
    direct = x < (a + 1) / (a + b + 2)
    res = np.empty_like(t)
    # each side's fraction settles in few rounds on its own values only
    if direct.any():
        res[direct] = -(front[direct] + np.log(_fraction(a[direct], b[direct], x[direct])) - np.log(a[direct])) / math.log(10)
    other = ~direct
    if other.any():
        comp = np.exp(front[other]) * _fraction(b[other], a[other], y[other]) / b[other]
        res[other] = -np.log1p(-np.minimum(comp, 1.0 - 1e-16)) / math.log(10)
    out[ok] = res
    return out


@F.pandas_udf(DoubleType())
def _neglog10p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(neglog10p_array(t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)))


def neglog10p(t: Column, df: Column) -> Column:
    p = _neglog10p(t.cast("double"), df.cast("double"))
    return F.when(~F.isnan(p), p)
