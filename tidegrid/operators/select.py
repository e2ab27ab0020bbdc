"""Slices, masks and coordinate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.sizing import calendar_side, checked_side


def time_range(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Months ``first``..``last``, both ends included; reaches the Parquet scan as a pushed filter."""
    if first is not None:
        df = df.filter(F.col("month_idx") >= first)
    return df if last is None else df.filter(F.col("month_idx") <= last)


def box(df: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """Inclusive coordinate box, e.g. ``box(df, lat=(-5, 5), lon=(10, 60), depth=(50, 100))``."""
    for name, (low, high) in ranges.items():
        df = df.filter(F.col(name).between(low, high))
    return df


def stride(df: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th latitude and longitude, by position on the grid."""
    return df.filter((F.col("lat_i") % every == 0) & (F.col("lon_i") % every == 0))


def levels(df: DataFrame, picked: list[int]) -> DataFrame:
    return df.filter(F.col("level").isin(picked))


def modes(df: DataFrame, picked: list[str], **fixed) -> DataFrame:
    """Rows of some modes at fixed scalar coordinates, which are dropped."""
    df = df.filter(F.col("mode").isin(picked))
    for name, value in fixed.items():
        df = df.filter(F.col(name) == value).drop(name)
    return df


def mask_cells(df: DataFrame, mask: DataFrame, on: tuple[str, ...] = ("lat_i", "lon_i")) -> DataFrame:
    """Keep the cells of a mask table; the mask is broadcast only when it was counted as small."""
    return df.join(checked_side(mask.select(*on).distinct()), list(on), "left_semi")


def drop_empty_axes(df: DataFrame, axes: tuple[str, ...] = ("lat_i", "lon_i")) -> DataFrame:
    """Drop the rows and columns of the grid that hold no value at all.

    The grid nodes that hold a value are stored once, so the field is read for them and for the result; nodes are few next to rows.
    """
    filled = checked_side(df.filter(F.col("value").isNotNull()).select(*axes).distinct())
    for axis in axes:
        df = df.join(filled.select(axis).distinct(), axis, "left_semi")
    return df


def mask_from_data(df: DataFrame, keys: list[str]) -> DataFrame:
    """1 where a cell has a time mean, NULL where it has none or a mean of zero."""
    mean = F.avg("value")
    return df.groupBy(*keys).agg(F.when(mean != 0, mean / mean).alias("mask"))


def n_months(df: DataFrame) -> Column:
    """Length of the time axis of a table, as a scalar subquery."""
    return df.select(F.count_distinct("month_idx").alias("n")).scalar()


def complete_cells(df: DataFrame, keys: list[str], n_times: int | Column | None = None) -> DataFrame:
    """Drop a cell when any time is missing. Rows must be unique per cell and month."""
    wanted = n_months(df) if n_times is None else (F.lit(n_times) if isinstance(n_times, int) else n_times)
    have = F.count("value").over(Window.partitionBy(*keys))
    return df.withColumn("_have", have).filter(F.col("_have") == wanted).drop("_have")


def unstack(df: DataFrame, cells: DataFrame, feature: str = "feature") -> DataFrame:
    """Back from feature numbers to the cells of a table ``(feature, ...)``; a feature without cell keeps its row with NULL coordinates."""
    return df.join(cells, feature, "left").drop(feature)


def where(value: str | Column, condition: Column) -> Column:
    """The value where the condition holds, NULL elsewhere."""
    return F.when(condition, F.col(value) if isinstance(value, str) else value)


def at_months(df: DataFrame, months: DataFrame) -> DataFrame:
    """Rows at the months of another table."""
    return df.join(calendar_side(months.select("month_idx").distinct()), "month_idx", "left_semi")


def without_months(df: DataFrame, months: DataFrame) -> DataFrame:
    return df.join(calendar_side(months.select("month_idx").distinct()), "month_idx", "left_anti")
