"""Climatology, trends and anomalies.

Rows are first reduced to one per cell and month (map-side sums, so a crowded source cell is
harmless); from then on a cell has at most as many rows as the calendar has months.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.calendar import month_of
from tidegrid.functions.coords import area_weight
from tidegrid.functions.sizing import calendar_side, checked_side
from tidegrid.operators.series_kernels import heavy

CELL = ["member", "lat_i", "lon_i"]


def monthly(df: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per cell and month: mean of the values and their number ``n``."""
    kept = [F.first(c, ignorenulls=True).alias(c) for c in carry]
    return df.groupBy(*keys, "month_idx").agg(F.avg("value").alias("value"), F.count("value").alias("n"), *kept)


def _monthly_weight(df: DataFrame) -> Column:
    return F.when(F.col("value").isNotNull(), F.col("n") if "n" in df.columns else F.lit(1))


def climatology(df: DataFrame, keys: list[str], baseline: tuple[int, int] | None = None) -> DataFrame:
    """Mean of each calendar month, from all observations or those of a baseline period."""
    if baseline is not None:
        df = df.filter(F.col("month_idx").between(*baseline))
    n = _monthly_weight(df)
    return df.groupBy(*keys, month_of(F.col("month_idx")).alias("month")).agg(
        (F.sum(F.col("value") * n) / F.sum(n)).alias("clim")
    )


def anomalies(df: DataFrame, keys: list[str], baseline: tuple[int, int] | None = None) -> DataFrame:
    """Departure from the own climatology, for a table unique per cell and month (see :func:`monthly`).

    The climatology is a window over (cell, calendar month): one exchange, no join.
    """
    inside = F.lit(True) if baseline is None else F.col("month_idx").between(*baseline)
    n = F.when(inside, _monthly_weight(df))
    by_month = Window.partitionBy(*keys, month_of(F.col("month_idx")))
    clim = F.sum(F.col("value") * n).over(by_month) / F.sum(n).over(by_month)
    return df.withColumn("value", F.col("value") - clim)


def area_mean(df: DataFrame, by: list[str], lat: str = "lat") -> DataFrame:
    """cos(latitude) weighted mean over the cells that have a value."""
    w = F.when(F.col("value").isNotNull(), area_weight(F.col(lat)))
    return df.groupBy(*by).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))


def box_mean(df: DataFrame, by: list[str]) -> DataFrame:
    """Plain mean over latitude, then over longitude (the order matters where cells are missing)."""
    return df.groupBy(*by, "lon_i").agg(F.avg("value").alias("value")).groupBy(*by).agg(F.avg("value").alias("value"))


# -- polynomial trends -----------------------------------------------------------------


def _solve_moments(s: list[Column], t: list[Column], deg: int) -> list[Column]:
    """Least-squares coefficients from power sums ``s`` and mixed sums ``t`` (degree 1 or 2); NULL with too few points."""
    if deg == 1:
        det = s[0] * s[2] - s[1] * s[1]
        return [F.try_divide(t[0] * s[2] - s[1] * t[1], det), F.try_divide(s[0] * t[1] - s[1] * t[0], det)]
    if deg != 2:
        raise ValueError("per-cell trends are of degree 1 or 2")
    a, b, c, d, e = s
    det = a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c)
    c0 = t[0] * (c * e - d * d) - b * (t[1] * e - d * t[2]) + c * (t[1] * d - c * t[2])
    c1 = a * (t[1] * e - d * t[2]) - t[0] * (b * e - d * c) + c * (b * t[2] - t[1] * c)
    c2 = a * (c * t[2] - d * t[1]) - b * (b * t[2] - t[1] * c) + t[0] * (b * d - c * c)
    return [F.try_divide(num, det) for num in (c0, c1, c2)]


def detrend_cells(df: DataFrame, keys: list[str], deg: int = 2, x: str = "month_idx") -> DataFrame:
    """Remove each cell's own polynomial in time; adds ``fit`` and ``slope`` (degree-1 term per month at month 0).

    Every sum is a window over the cell: one exchange, no join, all in the JVM. Values are taken around the cell's mean, so that a large
    offset costs no digits.
    """
    cell = Window.partitionBy(*keys)
    centre = (F.max(x).over(cell) + F.min(x).over(cell)) / 2
    half = F.greatest(F.lit(1.0), (F.max(x).over(cell) - F.min(x).over(cell)) / 2)
    df = df.withColumns({"_c": centre, "_h": half, "_m": F.avg("value").over(cell)}).withColumn("_u", (F.col(x) - F.col("_c")) / F.col("_h"))
    has = F.col("value").isNotNull()
    sums = {f"_s{i}": F.sum(F.when(has, F.pow("_u", F.lit(i)))).over(cell) for i in range(2 * deg + 1)}
    sums |= {f"_t{i}": F.sum(F.pow("_u", F.lit(i)) * (F.col("value") - F.col("_m"))).over(cell) for i in range(deg + 1)}
    df = df.withColumns(sums)
    coef = _solve_moments([F.col(f"_s{i}") for i in range(2 * deg + 1)], [F.col(f"_t{i}") for i in range(deg + 1)], deg)
    df = df.withColumns({f"_b{i}": c for i, c in enumerate(coef)})
    fit, slope = F.col(f"_b{deg}"), F.lit(0.0)
    for i in range(deg - 1, -1, -1):
        fit = fit * F.col("_u") + F.col(f"_b{i}")
    # d/dx at x = 0 of the polynomial in (x - centre) / half
    zero = -F.col("_c") / F.col("_h")
    for i in range(1, deg + 1):
        slope = slope + i * F.col(f"_b{i}") * F.pow(zero, F.lit(i - 1))
    out = df.withColumns({"fit": fit + F.col("_m"), "slope": slope / F.col("_h")})
    return out.withColumn("value", F.col("value") - F.col("_m") - fit).drop(
        "_c", "_h", "_u", "_m", *sums, *[f"_b{i}" for i in range(deg + 1)]
    )


_FIT = T.StructType(
    [
        T.StructField("centre", T.DoubleType()),
        T.StructField("half", T.DoubleType()),
        T.StructField("coefs", T.ArrayType(T.DoubleType())),
    ]
)


def polyfit_series(series: DataFrame, by: list[str], deg: int = 2, x: str = "month_idx") -> DataFrame:
    """Polynomial of a series per group: ``centre``, ``half`` and ``coefs`` in (x - centre) / half.

    A group is one index series (one row per month), so it fits a task by construction.
    """

    @heavy
    @F.pandas_udf(_FIT)
    def fit(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = []
        for xv, yv in zip(xs, ys):
            xv, yv = np.asarray(xv, dtype=float), np.asarray(yv, dtype=float)
            centre, half = (xv.max() + xv.min()) / 2, max(1.0, (xv.max() - xv.min()) / 2)
            coefs = np.linalg.lstsq(np.vander((xv - centre) / half, deg + 1, increasing=True), yv, rcond=None)[0]
            rows.append((centre, half, coefs))
        return pd.DataFrame(rows, columns=["centre", "half", "coefs"])

    packed = series.filter(F.col("value").isNotNull()).groupBy(*by).agg(
        F.collect_list(F.struct(F.col(x).alias("x"), F.col("value").alias("y"))).alias("_s")
    )
    return packed.select(*by, fit(F.col("_s.x").cast("array<double>"), F.col("_s.y")).alias("_f")).select(*by, "_f.*")


def trend_at(x: str, deg: int) -> Column:
    """Value at ``x`` of a polynomial produced by :func:`polyfit_series`."""
    u = (F.col(x) - F.col("centre")) / F.col("half")
    out = F.element_at("coefs", deg + 1)
    for i in range(deg, 0, -1):
        out = out * u + F.element_at("coefs", i)
    return out


@dataclass
class GlobalTrend:
    """Polynomial of the area mean per group; small tables next to the field."""

    by: list[str]
    deg: int
    mean: DataFrame
    params: DataFrame

    @cached_property
    def side(self) -> DataFrame:
        """The coefficients, stored once and counted before any broadcast."""
        return checked_side(self.params)

    def fit_at(self, months: DataFrame) -> DataFrame:
        """The fitted curve at the given (group, month) rows."""
        return months.join(self.params, self.by).select(*self.by, "month_idx", trend_at("month_idx", self.deg).alias("fit"))

    def remove(self, df: DataFrame) -> DataFrame:
        """Subtract the curve everywhere. The coefficients (a few numbers per group) travel, not the curve."""
        out = df.join(self.side, self.by).withColumn("value", F.col("value") - trend_at("month_idx", self.deg))
        return out.drop("centre", "half", "coefs")


def global_trend(df: DataFrame, by: list[str], deg: int = 2, lat: str = "lat") -> GlobalTrend:
    mean = area_mean(df, [*by, "month_idx"], lat)
    return GlobalTrend(by, deg, mean, polyfit_series(mean, by, deg))


def global_detrend(df: DataFrame, by: list[str], deg: int = 2, lat: str = "lat") -> DataFrame:
    """Remove the trend of the area mean from every cell."""
    return global_trend(df, by, deg, lat).remove(df)


@dataclass
class AnomalyModel:
    """Trend and climatology of one sample, applied to another (training to held-out data)."""

    trend: GlobalTrend
    clim: DataFrame
    keys: list[str]

    @classmethod
    def fit(cls, train: DataFrame, by: list[str], keys: list[str], deg: int = 2, lat: str = "lat") -> AnomalyModel:
        trend = global_trend(train, by, deg, lat)
        return cls(trend, climatology(trend.remove(train), keys), keys)

    def transform(self, df: DataFrame) -> DataFrame:
        """Anomalies stamped on their month; several observations of a month are averaged.

        A cell and calendar month without training climatology gives NULL.
        """
        flat = monthly(self.trend.remove(df), self.keys).withColumn("month", month_of(F.col("month_idx")))
        return flat.join(self.clim, [*self.keys, "month"], "left").select(
            *self.keys, "month_idx", (F.col("value") - F.col("clim")).alias("value")
        )


def subtract_monthly(df: DataFrame, monthly_values: DataFrame, name: str) -> DataFrame:
    """Field minus a function of time only (one row per month)."""
    return df.join(calendar_side(monthly_values), "month_idx").withColumn("value", F.col("value") - F.col(name)).drop(name)
