"""Tail probabilities, vectorised for Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter((math.lgamma(v) for v in np.ravel(x)), dtype=float, count=np.size(x)).reshape(np.shape(x))


def _beta_fraction(a, b, x, steps: int = 300):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps + 1):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    out[x <= 0] = 0.0
    out[x >= 1] = 1.0
    inner = (x > 0) & (x < 1)
    if inner.any():
        ai, bi, xi = a[inner], b[inner], x[inner]
        front = _lgamma(ai + bi) - _lgamma(ai) - _lgamma(bi)
        front = np.exp(front + ai * np.log(xi) + bi * np.log1p(-xi))
        low = xi < (ai + 1) / (ai + bi + 2)
        p, q = np.where(low, ai, bi), np.where(low, bi, ai)
        tail = front * _beta_fraction(p, q, np.where(low, xi, 1 - xi)) / p
        out[inner] = np.where(low, tail, 1 - tail)
    return out


def t_two_sided(t, df) -> np.ndarray:
    """Two-sided tail probability of Student's t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
        p = beta_inc(df / 2, 0.5, x)
    return np.where(np.isnan(t) | (df <= 0), np.nan, p)


@F.pandas_udf(T.DoubleType())
def _t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; NULL where either input is missing."""
    return _t_pvalue(t.cast("double"), df.cast("double"))


def pearson(a: str, b: str) -> Column:
    """Correlation over the complete pairs; NULL where one side is constant (``corr`` would raise)."""
    pair = F.col(a).isNotNull() & F.col(b).isNotNull()
    va, vb = F.var_pop(F.when(pair, F.col(a))), F.var_pop(F.when(pair, F.col(b)))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(va * vb))


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a Pearson correlation with ``n`` pairs (df = n - 2)."""
    ratio = F.try_divide(n - 2, F.greatest(F.lit(0.0), 1 - r * r))
    return F.when((n > 2) & r.isNotNull(), F.coalesce(r * F.sqrt(ratio), F.lit(float("inf"))))
