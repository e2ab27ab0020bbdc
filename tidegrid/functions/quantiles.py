"""Exact, linearly interpolated quantiles.

:func:`bounded_quantile` is for groups whose size is bounded by construction (bootstrap draws,
the months of one series, the fits of one ensemble). :func:`sorted_quantiles` is for groups of
any size: a distributed sort spreads a hot group over as many partitions as it needs. :func:`counted_quantiles`
exchanges counts only, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import cut_lineage

#: Bits of a value that each pass of the counts settles.
BITS = 13


def bounded_quantile(value: str | Column, p: float) -> Column:
    return F.percentile(value, F.lit(float(p)))


def array_quantile(values: str, p: float) -> Column:
    """The same of a sorted array without NULL that is not empty."""
    at = (F.size(values) - 1) * F.lit(float(p))
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def sorted_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Rows ``(*keys, prob, quantile)`` for groups that may hold any share of the table.

    Equal values are counted first; the distinct values are range-partitioned, so ranks come
    from per-partition counts plus one small running sum over partitions.
    """
    if not keys:
        return sorted_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs).drop("_all")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = cut_lineage(
        counted.repartitionByRange(*[F.col(k) for k in keys], F.col("_v")).withColumn("_part", F.spark_partition_id())
    )
    per_part = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_pc"))
    order = Window.partitionBy(*keys).orderBy("_part")
    per_part = per_part.withColumn(
        "_before", F.sum("_pc").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn("_total", F.sum("_pc").over(Window.partitionBy(*keys)))
    per_part = per_part.withColumn("_before", F.coalesce("_before", F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), ((F.col("_total") - 1) * F.lit(float(p))).alias("h")) for p in probs])
    ranks = (
        per_part.withColumn("_w", F.explode(wanted))
        .select(*keys, "_part", "_before", "_pc", "_w.prob", "_w.h")
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))))
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_pc")))
    )
    # only the partitions that hold a wanted rank are read again
    inside = Window.partitionBy(*keys, "_part").orderBy("_v")
    hit = (
        ranged.join(ranks.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi")
        .withColumn("_upto", F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    picked = hit.join(ranks, [*keys, "_part"]).filter(
        (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_c"))
        & (F.col("_rank") < F.col("_before") + F.col("_upto"))
    )
    frac = F.max(F.col("h") - F.floor("h"))
    return picked.groupBy(*keys, "prob").agg(
        (F.min_by("_v", "_rank") * (1 - frac) + F.max_by("_v", "_rank") * frac).alias("quantile")
    )


@F.pandas_udf(T.LongType())
def _ordered_bits(v: pd.Series) -> pd.Series:
    """Integers in the order of the doubles; both zeros are one."""
    bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(T.DoubleType())
def _from_bits(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(np.int64)
    return pd.Series((b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def counted_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Rows ``(*keys, prob, quantile)`` without a sort of the table.

    Doubles are read as integers in the same order, and their highest bits are counted per group. The count says in which bucket a
    wanted rank lies; the next pass counts further bits inside that bucket alone. After five passes all bits are known. What is
    exchanged is counts: at most a bucket for each value of `BITS` bits and each wanted rank, whatever the number of rows. NULL and NaN take no part.
    """
    if not keys:
        return counted_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs).drop("_all")
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    bits = cut_lineage(known.select(*[F.col(k).alias(a) for k, a in named.items()], _ordered_bits(F.col(value).cast("double")).alias("_bits")))
    by = list(named.values())
    shifts = [max(0, 64 - BITS * (i + 1)) for i in range(-(-64 // BITS))]
    wanted = None
    for i, shift in enumerate(shifts):
        bucket = F.shiftright("_bits", shift).alias("_bucket")
        if wanted is None:
            counts = bits.groupBy(*by, bucket).agg(F.count("*").alias("_c")).withColumn("_prefix", F.lit(0).cast("long"))
        else:
            same = F.shiftright("_bits", shifts[i - 1]) == F.col("_prefix")
            for a in by:
                same = same & F.col(a).eqNullSafe(F.col(f"_w{a}"))
            places = wanted.select(*[F.col(a).alias(f"_w{a}") for a in by], "_prefix").distinct()
            counts = bits.join(places, same).groupBy(*by, "_prefix", bucket).agg(F.count("*").alias("_c"))
        order = Window.partitionBy(*by, "_prefix").orderBy("_bucket")  # one row per bucket
        counts = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        if wanted is None:
            total = F.sum("_c").over(Window.partitionBy(*by))
            ranks = counts.withColumn("_total", total).withColumn("_prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            ranks = ranks.withColumn("_h", (F.col("_total") - 1) * F.col("_prob")).withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
            ranks = ranks.withColumn("_rank", F.col("_at"))
        else:
            same = F.col("_prefix") == F.col("_wp")
            for a in by:
                same = same & F.col(a).eqNullSafe(F.col(f"_w{a}"))
            ranks = counts.join(wanted.select(*[F.col(a).alias(f"_w{a}") for a in by], F.col("_prefix").alias("_wp"), "_prob", "_h", "_at", "_rank"), same)
        inside = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))
        found = ranks.filter(inside).select(*by, F.col("_bucket").alias("_prefix"), "_prob", "_h", "_at", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"))
        wanted = cut_lineage(found)
    frac = F.max(F.col("_h") - F.floor("_h"))
    values = wanted.withColumn("_v", _from_bits("_prefix")).groupBy(*by, "_prob")
    out = values.agg((F.min_by("_v", "_at") * (1 - frac) + F.max_by("_v", "_at") * frac).alias("quantile"))
    return out.select(*[F.col(a).alias(k) for k, a in named.items()], F.col("_prob").alias("prob"), "quantile")
