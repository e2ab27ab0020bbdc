"""Per-cell least squares on shared predictors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.sizing import calendar_side
from tidegrid.functions.stats import t_two_sided
from tidegrid.operators.series_kernels import heavy

_FIT = T.StructType(
    [
        T.StructField("coefs", T.ArrayType(T.DoubleType())),
        T.StructField("p_values", T.ArrayType(T.DoubleType())),
        T.StructField("r2", T.DoubleType()),
    ]
)


@heavy
@F.pandas_udf(_FIT)
def _solve(n: pd.Series, mx: pd.Series, cxx: pd.Series, cxy: pd.Series, my: pd.Series, cyy: pd.Series) -> pd.DataFrame:
    """Coefficients, p-values and R2 of a batch of cells from means and centred products (mean products, as population covariances)."""
    if not len(n):
        return pd.DataFrame({"coefs": [], "p_values": [], "r2": []})
    m, k = len(n), len(mx.iloc[0])
    nn, my, cyy = (s.to_numpy(float) for s in (n, my, cyy))
    origin, cxy = np.vstack(mx.to_numpy()).astype(float), np.vstack(cxy.to_numpy()).astype(float) * nn[:, None]
    upper = np.vstack(cxx.to_numpy()).astype(float) * nn[:, None]
    cyy = cyy * nn
    cxx = np.empty((m, k, k))
    rows, cols = np.triu_indices(k)
    cxx[:, rows, cols] = upper
    cxx[:, cols, rows] = upper
    coefs, p_values, r2 = np.full((m, k + 1), np.nan), np.full((m, k + 1), np.nan), np.full(m, np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.sqrt(np.einsum("mii->mi", cxx))
        sound = (nn > k + 1) & np.isfinite(cxx).all(axis=(1, 2)) & np.isfinite(cxy).all(axis=1)
        sound &= (scale > 0).all(axis=1)
        i = np.flatnonzero(sound)
        # collinear predictors have no unique coefficients
        i = i[np.linalg.cond(cxx[i] / (scale[i, :, None] * scale[i, None, :])) < 1e12]
        if len(i):
            inv = np.linalg.inv(cxx[i])
            b = np.einsum("mij,mj->mi", inv, cxy[i])
            sse = np.maximum(cyy[i] - np.einsum("mi,mi->m", b, cxy[i]), 0.0)
            free = nn[i] - k - 1
            s2 = sse / free
            var0 = s2 * (1 / nn[i] + np.einsum("mi,mij,mj->m", origin[i], inv, origin[i]))
            se = np.sqrt(np.column_stack([var0, s2[:, None] * np.einsum("mii->mi", inv)]))
            coefs[i] = np.column_stack([my[i] - np.einsum("mi,mi->m", b, origin[i]), b])
            p_values[i] = t_two_sided(coefs[i] / se, free[:, None])
            r2[i] = 1 - sse / cyy[i]

    def lists(a):
        return [None if np.isnan(row).all() else [None if np.isnan(v) else v for v in row] for row in a]

    return pd.DataFrame({"coefs": lists(coefs), "p_values": lists(p_values), "r2": [None if np.isnan(v) else v for v in r2]})


def with_predictors(df: DataFrame, predictors: DataFrame, names: list[str], shared: list[str] | None = None) -> DataFrame:
    """Field rows next to the predictors of their month; ``shared`` keys make predictors differ by group."""
    cols = predictors.select(*(shared or []), "month_idx", *names)
    return df.join(cols, [*shared, "month_idx"]) if shared else df.join(calendar_side(cols), "month_idx")


def ols(
    df: DataFrame,
    predictors: DataFrame,
    names: list[str],
    keys: list[str],
    shared: list[str] | None = None,
    drop_missing: bool = False,
    n_times: Column | None = None,
) -> DataFrame:
    """One row per cell: ``coefs`` and ``p_values`` (intercept first), ``r2`` and ``n``.

    Only partial moments leave a map task, so the field is never exchanged row by row. They are counts, means and centred products that
    are merged in pairs, so that large offsets of values or predictors cost no digits. A month without a value, or without one of the
    predictors, is missing. A cell with missing months gives NULL unless ``drop_missing``; so do collinear predictors (a condition
    number of their correlations of 1e12 or more).
    """
    k = len(names)
    z = with_predictors(df, predictors, names, shared)
    has = F.col("value").isNotNull()
    for name in names:
        has = has & F.col(name).isNotNull()
    y, x = F.when(has, F.col("value").cast("double")), [F.when(has, F.col(name).cast("double")) for name in names]
    moments = z.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.array(*[F.avg(v) for v in x]).alias("mx"),
        F.array(*[F.covar_pop(x[i], x[j]) for i in range(k) for j in range(i, k)]).alias("cxx"),
        F.array(*[F.covar_pop(v, y) for v in x]).alias("cxy"),
        F.avg(y).alias("my"),
        F.var_pop(y).alias("cyy"),
    )
    if not drop_missing:
        wanted = predictors.select(F.count_distinct("month_idx").alias("n")).scalar() if n_times is None else n_times
        moments = moments.withColumn("n", F.when(F.col("n") == wanted, F.col("n")).otherwise(F.lit(0)))
    fit = _solve(F.col("n").cast("double"), "mx", "cxx", "cxy", "my", "cyy")
    return moments.select(*keys, "n", fit.alias("f")).select(*keys, "n", "f.*")


def coefficients(fit: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Long form: one row per cell and term (``intercept`` and the predictor names)."""
    terms = F.arrays_zip(F.lit(["intercept", *names]).alias("mode"), F.col("coefs").alias("coef"), F.col("p_values").alias("p_value"))
    return fit.filter(F.col("coefs").isNotNull()).select(*keys, F.explode(terms).alias("t")).select(*keys, "t.mode", "t.coef", "t.p_value")


def standardized(coefs: DataFrame, predictors: DataFrame, names: list[str]) -> DataFrame:
    """Coefficients times the population deviation of their predictor."""
    spread = predictors.agg(F.map_from_arrays(F.lit(list(names)), F.array(*[F.stddev_pop(n) for n in names])).alias("m"))
    return coefs.filter(F.col("mode") != "intercept").withColumn("coef", F.col("coef") * F.element_at(spread.scalar(), F.col("mode")))


def residuals(df: DataFrame, predictors: DataFrame, fit: DataFrame, names: list[str], keys: list[str], shared: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Field minus its fitted values; with ``keep``, both: ``value`` and ``residual``."""
    z = with_predictors(df, predictors, names, shared).join(fit.select(*keys, "coefs"), keys)
    fitted = F.element_at("coefs", 1)
    for i, name in enumerate(names):
        fitted = fitted + F.element_at("coefs", i + 2) * F.col(name)
    left = F.col("value") - fitted
    return z.select(*keys, "month_idx", "value", left.alias("residual")) if keep else z.select(*keys, "month_idx", left.alias("value"))
