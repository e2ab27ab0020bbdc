"""Lagged Pearson correlation of monthly series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.stats import correlation_t, t_pvalue
from tidegrid.operators.series_kernels import heavy

_CELLS = T.StructType(
    [
        T.StructField("month", T.ArrayType(T.IntegerType())),
        T.StructField("lag", T.ArrayType(T.IntegerType())),
        T.StructField("r", T.ArrayType(T.DoubleType())),
        T.StructField("n", T.ArrayType(T.LongType())),
    ]
)

#: Lags from which transforms take the place of products lag by lag; both give the same sums.
MANY_LAGS = 512

#: Values of a block of lags.
BLOCK_VALUES = 4_000_000


def lagged_pairs(x: DataFrame, y: DataFrame, keys: list[str], max_lag: int, step: int = 1) -> DataFrame:
    """Rows ``(keys, month_idx, lag, x, y)`` with ``y`` taken ``lag`` steps after ``x``.

    The lag is added to the integer month, so this is a hash or sort-merge join; months outside
    the span of ``y`` have no partner.
    """
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    left = x.filter(F.col("value").isNotNull()).select(*keys, "month_idx", F.col("value").alias("x"), lags)
    left = left.withColumn("_at", F.col("month_idx") + F.col("lag") * step)
    right = y.filter(F.col("value").isNotNull()).select(*keys, F.col("month_idx").alias("_at"), F.col("value").alias("y"))
    return left.join(right, [*keys, "_at"]).drop("_at")


def _sums_by_lag(x: np.ndarray, y: np.ndarray, lags: np.ndarray, period: int, first: int) -> np.ndarray:
    """``(6, lags, period)``: pairs, sums of x, y, xx, yy and xy of the complete pairs, by calendar position of x; NaN are gaps.

    Blocks of lags are one matrix: y moved by each lag next to x, whole years below each other.
    """
    span = len(x)
    lead, tail = first % period, -(first % period + span) % period
    reach = int(np.abs(lags).max()) if len(lags) else 0
    wide = np.concatenate([np.full(lead, np.nan), x, np.full(tail, np.nan)])
    padded = np.full(len(wide) + 2 * reach, np.nan)
    padded[reach + lead : reach + lead + span] = y
    views = np.lib.stride_tricks.sliding_window_view(padded, len(wide))
    out = np.empty((6, len(lags), period))
    step = max(1, BLOCK_VALUES // max(1, len(wide)))
    for i in range(0, len(lags), step):
        moved = views[reach + lags[i : i + step]]
        both = np.isfinite(moved) & np.isfinite(wide)
        a, b = np.where(both, wide, 0.0), np.where(both, moved, 0.0)
        # centred once more over the pairs of a lag and position, so that no digits are lost
        shape = (len(a), -1, period)
        n = both.reshape(shape).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            means = [np.where(n > 0, v.reshape(shape).sum(axis=1) / n, 0.0) for v in (a, b)]
        a, b = (np.where(both.reshape(shape), v.reshape(shape) - m[:, None, :], 0.0) for v, m in zip((a, b), means, strict=True))
        out[:, i : i + step] = n, a.sum(axis=1), b.sum(axis=1), (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)
    return out


def _sums_by_transform(x: np.ndarray, y: np.ndarray, lags: np.ndarray, period: int, first: int) -> np.ndarray:
    """As :func:`_sums_by_lag`, all lags at once: pairs, sums, squares and products are correlations of masked series, one transform each."""
    span = len(x)
    size = 1 << (2 * span - 1).bit_length()
    mx, my = np.isfinite(x), np.isfinite(y)
    a, b = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    there, plain, square = (np.fft.rfft(v, size) for v in (my.astype(float), b, b * b))
    at = np.remainder(lags, size)
    out = np.empty((6, len(lags), period))
    for p in range(period):
        here = (first + np.arange(span)) % period == p
        m, v, w = (np.conj(np.fft.rfft(np.where(here, z, 0.0), size)) for z in (mx.astype(float), a, a * a))
        found = [np.fft.irfft(c, size)[at] for c in (m * there, v * there, m * plain, w * there, m * square, v * plain)]
        found[0] = np.rint(found[0])
        out[:, :, p] = found
    return out


def _lag_table(t: np.ndarray, x: np.ndarray, y: np.ndarray, max_lag: int, step: int, by_month: bool) -> tuple[np.ndarray, ...]:
    """Month, lag, r and pairs of one pair of series on the time axis ``t`` (with gaps as NaN); lags beyond its span have ``n`` 0."""
    span = int(t[-1] - t[0]) + 1
    full = np.full((2, span), np.nan)
    full[:, t - t[0]] = x, y
    full -= np.nanmean(full, axis=1, keepdims=True)
    scale = np.nanmax(np.abs(full), axis=1)
    period, first = (12, int(t[0])) if by_month else (1, 0)
    lag = np.arange(-max_lag, max_lag + 1)
    near = np.flatnonzero(np.abs(lag * step) < span)
    transform = len(near) >= MANY_LAGS
    s = np.zeros((6, len(lag), period))
    s[:, near] = (_sums_by_transform if transform else _sums_by_lag)(full[0], full[1], lag[near] * step, period, first)
    n, sa, sb, saa, sbb, sab = s
    with np.errstate(invalid="ignore", divide="ignore"):
        saa, sbb, sab = saa - sa * sa / n, sbb - sb * sb / n, sab - sa * sb / n
        r = np.clip(sab / np.sqrt(saa * sbb), -1.0, 1.0)
    # a sum of squares that is rounding error alone is that of a constant
    least = 1e-13 * span * scale**2 if transform else np.zeros(2)
    r[~((n > 1) & (saa > least[0]) & (sbb > least[1]))] = np.nan
    beyond = np.ones(len(lag), dtype=bool)
    beyond[near] = False
    i, m = np.nonzero((n > 0) | beyond[:, None])
    return (m + 1).astype(np.int32), lag[i].astype(np.int32), r[i, m], n[i, m].astype(np.int64)


def _correlate(x: DataFrame, y: DataFrame, keys: list[str], max_lag: int, step: int, by_month: bool) -> DataFrame:
    """Both series of a key meet in one row, so lags are array offsets and are never exchanged.

    Repeated months are averaged with map-side sums; a row is then as long as the calendar.
    """

    @heavy
    @F.pandas_udf(_CELLS)
    def table(ts: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = [_lag_table(np.asarray(t), np.asarray(a, dtype=float), np.asarray(b, dtype=float), max_lag, step, by_month) for t, a, b in zip(ts, xs, ys)]
        return pd.DataFrame({name: [row[i] for row in rows] for i, name in enumerate(("month", "lag", "r", "n"))})

    none = F.lit(None).cast("double")
    both = x.select(*keys, "month_idx", F.col("value").alias("x"), none.alias("y"))
    both = both.unionByName(y.select(*keys, "month_idx", none.alias("x"), F.col("value").alias("y")))
    months = both.groupBy(*keys, "month_idx").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    packed = months.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("month_idx", "x", "y"))).alias("s"))
    packed = packed.filter(F.exists("s", lambda p: p["x"].isNotNull()) & F.exists("s", lambda p: p["y"].isNotNull()))
    found = packed.select(*keys, table(F.col("s.month_idx"), F.col("s.x"), F.col("s.y")).alias("c"))
    cells = found.select(*keys, F.explode(F.arrays_zip("c.month", "c.lag", "c.r", "c.n")).alias("c"))
    r = F.nanvl(F.col("c.r"), F.lit(None).cast("double")).alias("r")
    out = cells.select(*keys, *(["c.month"] if by_month else []), "c.lag", r, "c.n")
    t = correlation_t(F.col("r"), F.col("n"))
    return out.withColumn("p_value", t_pvalue(t, (F.col("n") - 2).cast("double")))


def cross_correlation_by_month(x: DataFrame, y: DataFrame, keys: list[str], max_lag: int = 36, step: int = 1) -> DataFrame:
    """Correlation per calendar month of ``x`` and lag; a negative lag means ``y`` precedes ``x``."""
    return _correlate(x, y, keys, max_lag, step, True)


def cross_correlation(x: DataFrame, y: DataFrame, keys: list[str], max_lag: int = 36, step: int = 1) -> DataFrame:
    """Correlation per lag over all months."""
    return _correlate(x, y, keys, max_lag, step, False)


def significant(corr: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Correlation kept where its p-value does not exceed ``alpha``."""
    return corr.withColumn("r_significant", F.when(F.col("p_value") <= alpha, F.col("r")))
