"""Reconstruction error and variance explained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subtract(a: DataFrame, b: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Aligned difference on the shared labels."""
    return a.join(b.select(*on, F.col(value).alias("_b")), on).withColumn(value, F.col(value) - F.col("_b")).drop("_b")


def mean_squared_error(a: DataFrame, b: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Mean squared difference over the shared labels, per ``by`` group of ``a``."""
    d = subtract(a, b, on)
    return d.groupBy(*by).agg(F.avg(F.col("value") * F.col("value")).alias("mse"))


def total_variance(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Population variance in time of each cell, summed over the cells of a group."""
    cells = df.groupBy(*keys).agg(F.var_pop("value").alias("v"))
    return cells.groupBy(*by).agg(F.sum("v").alias("variance"))


def variance_explained(full: DataFrame, without: DataFrame, keys: list[str], by: list[str], mode: str = "mode") -> DataFrame:
    """1 - variance without a mode over the full variance, per group and mode left out."""
    whole = total_variance(full, keys, by)
    part = total_variance(without, [*keys, mode], [*by, mode]).withColumnRenamed("variance", "_part")
    return part.join(whole, by).select(*by, mode, (1 - F.try_divide("_part", "variance")).alias("explained"))
