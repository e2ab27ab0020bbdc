"""Grouped-map kernels on whole series.

A series is packed into one row (arrays ordered by time), many rows travel in one Arrow batch,
and numpy works on all equally long series of a batch at once. One series has at most one value
per time step, so the rows of a group are bounded by the length of the time axis.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Kernel = Callable[[np.ndarray], np.ndarray]

# values that one kernel call works on, so that memory does not depend on the Arrow batch size
BLOCK_VALUES = 2_000_000


def heavy(udf):
    """Mark a kernel so that the optimizer neither repeats it nor pushes filters through it."""
    return udf.asNondeterministic()


def pack_series(df: DataFrame, keys: list[str], t: str = "month_idx", value: str = "value", unique: bool = False, even: bool = False) -> DataFrame:
    """One row per series: arrays ``ts`` and ``vs`` ordered by time.

    Repeated times are averaged first, with map-side sums, so that a crowded key cannot flood the
    task that packs it; a table already grouped by these keys is not exchanged again for that.
    ``unique=True`` skips the step. With ``even``, a series whose times do not follow in equal steps has NULL values: a step
    that is absent is a gap like one that is NULL.
    """
    if not unique:
        df = df.groupBy(*keys, t).agg(F.avg(value).alias(value))
    rows = F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v"))))
    packed = df.groupBy(*keys).agg(rows.alias("_s")).select(*keys, F.col("_s.t").alias("ts"), F.col("_s.v").alias("vs"))
    return packed.withColumn("vs", F.when(even_steps("ts"), F.col("vs")).otherwise(nothing_like("ts"))) if even else packed


def nothing_like(ts: str) -> Column:
    """An array of NULL as long as another one."""
    return F.transform(ts, lambda _: F.lit(None).cast("double"))


def even_steps(ts: str) -> Column:
    """Whether sorted times follow in equal steps."""
    n = F.size(ts)
    steps = F.zip_with(F.slice(ts, 2, F.greatest(n - 1, F.lit(0))), F.slice(ts, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    return F.size(F.array_distinct(steps)) <= 1


def blockwise(values: pd.Series, fn: Kernel) -> pd.Series:
    """Apply ``fn`` to blocks of equally long, gap-free series; others give None."""
    out: list = [None] * len(values)
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None and len(v):
            by_length.setdefault(len(v), []).append(i)
    for length, whole in by_length.items():
        step = max(1, BLOCK_VALUES // length)
        for idx in (whole[s : s + step] for s in range(0, len(whole), step)):
            block = np.vstack([np.asarray(values.iloc[i], dtype=float) for i in idx])
            good = np.isfinite(block).all(axis=1)
            if good.any():
                for i, row in zip(np.asarray(idx)[good], fn(block[good])):
                    out[i] = row
    return pd.Series(out, dtype=object)


def array_kernel(fn: Kernel) -> Callable[[Column], Column]:
    """Column function array<double> -> array<double> that runs ``fn`` on blocks of series."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        return blockwise(values, fn)

    return heavy(run)


def unpack_series(packed: DataFrame, keys: list[str], t: str = "month_idx", value: str = "value", values: str = "vs") -> DataFrame:
    """Back to one row per time step."""
    whole = F.coalesce(values, nothing_like("ts"))
    return packed.select(*keys, F.explode(F.arrays_zip(F.col("ts").alias("t"), whole.alias("v"))).alias("_p")).select(
        *keys, F.col("_p.t").alias(t), F.col("_p.v").alias(value)
    )


def apply_per_series(
    df: DataFrame, keys: list[str], fn: Kernel, t: str = "month_idx", value: str = "value", unique: bool = False
) -> DataFrame:
    """Run a length-preserving kernel on every series: one exchange on the series keys."""
    packed = pack_series(df, keys, t, value, unique, even=True)
    return unpack_series(packed.withColumn("vs", array_kernel(fn)("vs")), keys, t, value)
