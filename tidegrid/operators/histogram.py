"""Joint histograms of members, one-dimensional densities and kernel density."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.sizing import checked_side
from tidegrid.session import cut_lineage


def bin_of(x: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """Equal bins, the last one closed; NULL outside the range."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    raw = F.floor((x - low) / ((high - low) / bins)).cast("int")
    return F.when((x >= low) & (x <= high), F.least(raw, F.lit(bins - 1)))


def joint_histogram(df: DataFrame, by: list[str], x: str, y: str, bins: int = 45, low: float = -5.0, high: float = 5.0) -> DataFrame:
    """Share of pairs per bin of each member: rows ``(*by, bx, by, density)``, empty bins left out."""
    binned = df.select(*by, bin_of(F.col(x), low, high, bins).alias("bx"), bin_of(F.col(y), low, high, bins).alias("by"))
    counts = binned.filter(F.col("bx").isNotNull() & F.col("by").isNotNull()).groupBy(*by, "bx", "by").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("density", F.col("n") / total).drop("n")


def histogram_summary(hist: DataFrame, member: list[str], tolerance: float = 0.25, cut: float = 1e-6, agree: float = 0.9) -> DataFrame:
    """Mean and spread over members per bin, and where most members agree with the mean.

    An absent bin of a member is a zero. ``share`` counts members strictly within
    ``tolerance`` of the mean; a mean below ``cut`` is missing and no member agrees with it.
    """
    hist = cut_lineage(hist)  # read three times below, and small next to the pairs it came from
    members = hist.select(F.count_distinct(*member).alias("n")).scalar()
    bins = hist.groupBy("bx", "by").agg(
        F.sum("density").alias("s"), F.sum(F.col("density") * F.col("density")).alias("s2")
    ).withColumn("members", members)
    mean = bins.withColumns(
        {
            "mean": F.col("s") / F.col("members"),
            "std": F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("members") - F.pow(F.col("s") / F.col("members"), 2))),
        }
    )
    total = mean.agg(F.sum("mean").alias("t")).scalar()
    mean = mean.withColumn("mean", F.col("mean") / total)
    mean = mean.withColumn("mean", F.when(F.col("mean") >= cut, F.col("mean"))).select("bx", "by", "mean", "std", "members")
    near = (F.col("density") > F.col("mean") * (1 - tolerance)) & (F.col("density") < F.col("mean") * (1 + tolerance))
    hits = hist.join(mean, ["bx", "by"]).groupBy("bx", "by").agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"), (F.count(F.when(near, 1)) / F.first("members")).alias("share")
    )
    return hits.withColumn("agreed", F.col("share") > agree)


def _bounds(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Range of each group; a group of equal values gets a range of one around it."""
    flat = F.when(F.min(value) == F.max(value), 0.5).otherwise(0.0)
    return df.groupBy(*by).agg((F.min(value) - flat).alias("_lo"), (F.max(value) + flat).alias("_hi"), F.count(value).alias("_n"))


def density_histogram(df: DataFrame, by: list[str], value: str = "value", bins: int = 30) -> DataFrame:
    """Density over equal bins between each group's extremes."""
    z = df.filter(F.col(value).isNotNull()).join(checked_side(_bounds(df, by, value)), by)
    binned = z.groupBy(*by, bin_of(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return binned.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), (F.col("n") / (F.col("_n") * width)).alias("density"))


def kernel_density(df: DataFrame, by: list[str], value: str = "value", points: int = 200) -> DataFrame:
    """Gaussian density with Scott's bandwidth on a grid over the range of all groups; NULL for equal values.

    Blocks of values are laid over the grid inside their own map task; only ``points`` sums per block are exchanged.
    """
    present = df.filter(F.col(value).isNotNull())
    spread = checked_side(
        present.groupBy(*by).agg(
            F.count("*").alias("_n"),
            (F.stddev_samp(value) * F.pow(F.count("*"), F.lit(-0.2))).alias("_h"),
            F.min(value).alias("_lo"),
            F.max(value).alias("_hi"),
        )
    )
    lo, hi = spread.agg(F.min("_lo").alias("v")).scalar(), spread.agg(F.max("_hi").alias("v")).scalar()
    z = present.join(spread, by).select(*by, F.col(value).cast("double").alias("_v"), "_n", "_h", lo.cast("double").alias("_from"), hi.cast("double").alias("_to"))
    schema = T.StructType([*[df.schema[k] for k in by], T.StructField("point", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("x", "_s", "_n", "_h")]])

    def sums(batches):
        # one row per batch, group and point: a block of values times the grid
        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]:
                if not len(part):
                    continue
                head = part.iloc[0]
                x = head["_from"] + (head["_to"] - head["_from"]) * np.arange(points) / (points - 1)
                total = np.zeros(points)
                with np.errstate(divide="ignore", invalid="ignore"):
                    for at in range(0, len(part), 4096):
                        u = (x[None, :] - part["_v"].to_numpy(float)[at : at + 4096, None]) / head["_h"]
                        total += np.exp(-0.5 * u * u).sum(axis=0)
                out = pd.DataFrame({"point": np.arange(points, dtype=np.int32), "x": x, "_s": total, "_n": float(head["_n"]), "_h": head["_h"]})
                for name, k in zip(by, key if isinstance(key, tuple) else (key,)):
                    out[name] = k
                yield out[[*by, "point", "x", "_s", "_n", "_h"]]

    scale = F.first("_n") * F.nullif(F.first("_h"), F.lit(0.0)) * F.sqrt(2 * F.pi())
    dens = F.when(F.first("_h") > 0, F.try_divide(F.sum("_s"), scale))
    return z.mapInPandas(sums, schema).groupBy(*by, "point").agg(F.first("x").alias("x"), dens.alias("density"))
