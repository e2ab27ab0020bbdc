"""Windows and transforms of series that are too long for one task.

A window over a key puts a whole series into one task. Here a series is cut into blocks of its axis, and a task holds blocks: moving
windows get the rows that reach in from the neighbours (halo rows), running sums and gap filling get what the blocks before and
after hand on, which is one row per block. The Fourier transform is split into columns and rows (two exchanges).
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.sizing import checked_side
from tidegrid.operators.series_kernels import heavy

#: Steps of a block.
BLOCK = 1 << 16


def over_blocks(df: DataFrame, keys: list[str], x: str, before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], size: int = BLOCK) -> DataFrame:
    """Columns over a moving window of an integer axis, from ``before`` steps back to ``after`` steps ahead; ``make`` gets the window.

    A row is copied into the blocks that its neighbours' windows reach from, at most one each way: blocks are made as long as the
    window. Rows are exchanged by key and block. A row without a place on the axis has a window of its own.
    """
    size = max(size, before, after)
    block, offset = F.floor(F.col(x) / size), F.pmod(F.col(x), F.lit(size))
    places = F.array(F.lit(0), F.when(offset >= size - before, 1), F.when(offset < after, -1))
    rows = df.withColumn("_block", block).withColumn("_to", F.explode(F.filter(places, lambda p: p.isNotNull())))
    rows = rows.withColumn("_block", F.col("_block") + F.col("_to"))
    w = Window.partitionBy(*keys, "_block").orderBy(x).rangeBetween(-before, after)
    return rows.withColumns({f"_new_{n}": c for n, c in make(w).items()}).filter("_to = 0").drop("_block", "_to", *[n for n in make(w) if n in df.columns]).withColumnsRenamed(
        {f"_new_{n}": n for n in make(w)}
    )


def centred_mean_blocks(df: DataFrame, keys: list[str], width: int = 3, x: str = "month_idx", value: str = "value", size: int = BLOCK) -> DataFrame:
    """As :func:`tidegrid.operators.series.centred_mean`, in blocks."""
    half = width // 2
    return over_blocks(df, keys, x, half, width - 1 - half, lambda w: {value: F.when(F.count(value).over(w) == width, F.avg(value).over(w))}, size)


def trailing_sum_blocks(df: DataFrame, keys: list[str], width: int = 24, x: str = "month_idx", value: str = "value", size: int = BLOCK) -> DataFrame:
    """As :func:`tidegrid.operators.series.trailing_sum`, in blocks."""
    return over_blocks(df, keys, x, width - 1, 0, lambda w: {value: F.when(F.count(value).over(w) == width, F.sum(value).over(w))}, size)


def _carried(df: DataFrame, keys: list[str], x: str, size: float, summary: dict[str, Column], carry: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Rows with ``_block`` and what the other blocks of their key hand on. Blocks are summed up with map-side sums, one row each."""
    rows = df.withColumn("_block", F.floor(F.col(x) / size))
    known = {k: f"_k{i}" for i, k in enumerate(keys)}
    sums = rows.groupBy(*keys, "_block").agg(*[c.alias(n) for n, c in summary.items()])
    given = sums.withColumns(carry(Window.partitionBy(*keys).orderBy("_block")))
    given = given.select(*[F.col(k).alias(a) for k, a in known.items()], F.col("_block").alias("_b"), *carry(Window.orderBy("_block")))
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for k, a in known.items():
        same = same & F.col(k).eqNullSafe(F.col(a))
    return rows.join(given, same, "left").drop("_b", *known.values())


def cumulative_sum_blocks(df: DataFrame, keys: list[str], x: str, value: str = "value", name: str = "cumulative", size: int = BLOCK) -> DataFrame:
    """Running sum along ``x``, which is unique in a series; a NULL adds nothing, and before the first value the sum is NULL."""
    rows = _carried(
        df, keys, x, size, {"_sum": F.sum(value)}, lambda w: {"_before": F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1))}
    )
    inner = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(inner.isNull(), F.col("_before")).otherwise(F.coalesce("_before", F.lit(0.0)) + inner)
    return rows.withColumn(name, total).drop("_block", "_before")


def fill_gaps_blocks(df: DataFrame, keys: list[str], x: str = "lat", value: str = "value", size: float = BLOCK) -> DataFrame:
    """As :func:`tidegrid.operators.series.fill_gaps`, in blocks of ``size`` units of ``x``."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(value).alias("v")))
    rows = _carried(
        df, keys, x, size, {"_first": F.min(point), "_last": F.max(point)},
        lambda w: {
            "_left": F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_right": F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        },
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(x)
    left = F.coalesce(F.last(point, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_left"))
    right = F.coalesce(F.first(point, True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("_right"))
    rows = rows.withColumns({"_l": left, "_r": right})
    share = F.try_divide(F.col(x) - F.col("_l.x"), F.col("_r.x") - F.col("_l.x"))
    between = F.col("_l.v") + share * (F.col("_r.v") - F.col("_l.v"))
    return rows.withColumn(value, F.coalesce(F.col(value), between)).drop("_block", "_left", "_right", "_l", "_r")


# -- Fourier transform in two steps ----------------------------------------------------------

_COMPLEX = T.StructType([T.StructField("re", T.ArrayType(T.DoubleType())), T.StructField("im", T.ArrayType(T.DoubleType()))])


def _transforms(inverse: bool, twiddle: int = 0):
    """Transform of each row's complex values; with ``twiddle`` N, entry k1 of row n2 is turned by n2 * k1 / N of a circle."""

    @heavy
    @F.pandas_udf(_COMPLEX)
    def run(re: pd.Series, im: pd.Series, at: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, row in zip(re, im, at, strict=True):
            z = np.asarray(a, dtype=float) + 1j * np.asarray(b, dtype=float)
            z = np.fft.ifft(z) * len(z) if inverse else np.fft.fft(z)
            if twiddle:
                turn = np.remainder(int(row) * np.arange(len(z)), twiddle) / twiddle
                z = z * np.exp((2j if inverse else -2j) * np.pi * turn)
            out.append((z.real, z.imag))
        return pd.DataFrame({"re": [x for x, _ in out], "im": [x for _, x in out]})

    return run


def split_transform(df: DataFrame, keys: list[str], length: int, rows: int, inverse: bool = False) -> DataFrame:
    """Discrete Fourier transform of complex series ``(*keys, n, re, im)`` of ``length`` steps, as ``(*keys, n, re, im)``.

    ``rows`` divides the length. With n = columns * n1 + n2, the transform over n1 runs per n2, is turned, and the one over n2 runs
    per frequency of the first: two exchanges, and a task holds rows of ``rows`` or ``length / rows`` values. The inverse isn't scaled.
    """
    if rows < 1 or length % rows:
        raise ValueError("the rows must divide the length")
    columns = length // rows

    def step(z: DataFrame, group: str, order: str, kernel) -> DataFrame:
        packed = z.groupBy(*keys, group).agg(F.sort_array(F.collect_list(F.struct(order, "re", "im"))).alias("s"))
        done = packed.select(*keys, group, kernel(F.col("s.re"), F.col("s.im"), F.col(group)).alias("z"))
        return done.select(*keys, group, F.posexplode(F.arrays_zip(F.col("z.re"), F.col("z.im"))).alias("to", "v")).select(*keys, group, F.col("to").cast("long").alias("to"), "v.re", "v.im")

    z = df.select(*keys, F.floor(F.col("n") / columns).alias("n1"), F.pmod(F.col("n"), F.lit(columns)).alias("n2"), "re", "im")
    z = step(z, "n2", "n1", _transforms(inverse, length)).withColumnRenamed("to", "k1")
    z = step(z, "k1", "n2", _transforms(inverse))
    return z.select(*keys, (F.col("k1") + rows * F.col("to")).alias("n"), "re", "im")


def _divisor(length: int, block: int) -> int:
    """The divisor nearest below or at a block size (or the root of the length, if smaller)."""
    most = max(1, min(block, isqrt(length)))
    return next(d for d in range(most, 0, -1) if length % d == 0)


def long_transform(df: DataFrame, keys: list[str], length: int, block: int = BLOCK) -> DataFrame:
    """Transform of real or complex series of any length in tasks of about ``block`` values.

    A length without a divisor near the block size (a prime, say) is brought to one that is a power of two by a chirp: the product
    n * k is half of n**2 + k**2 - (k - n)**2, which makes the transform a convolution.
    """
    rows = _divisor(length, block)
    if length // rows <= max(block, 4 * isqrt(length)):
        return split_transform(df, keys, length, rows)
    wide = 1 << (2 * length - 2).bit_length()
    rows = min(1 << (max(2, block).bit_length() - 1), 1 << (wide.bit_length() // 2))

    def chirp(n: Column, sign: float) -> tuple[Column, Column]:
        angle = F.pmod(n * n, F.lit(2 * length)) * (np.pi / length)
        return F.cos(angle), sign * F.sin(angle)

    def times(z: DataFrame, c: tuple[Column, Column], n: Column | str = "n") -> DataFrame:
        re, im = F.col("re"), F.col("im")
        return z.select(*keys, F.col(n) if isinstance(n, str) else n.alias("n"), (re * c[0] - im * c[1]).alias("re"), (re * c[1] + im * c[0]).alias("im"))

    def padded(z: DataFrame) -> DataFrame:
        zeros = z.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(length).cast("long"), F.lit(wide - 1).cast("long"))).alias("n"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        return z.unionByName(zeros)

    spark, n = df.sparkSession, F.col("n")
    turned = split_transform(padded(times(df, chirp(n, -1.0))), keys, wide, rows)
    # the filter is the same for all series: a chirp that starts at 0 and wraps around
    at = F.when(n < length, n).when(n > wide - length, wide - n)
    c = chirp(at, 1.0)
    base = spark.range(wide).withColumnRenamed("id", "n").select("n", F.coalesce(c[0], F.lit(0.0)).alias("re"), F.coalesce(c[1], F.lit(0.0)).alias("im"))
    filt = split_transform(base, [], wide, rows).select("n", F.col("re").alias("fr"), F.col("im").alias("fi"))
    both = turned.join(checked_side(filt), "n")
    product = both.select(*keys, "n", (F.col("re") * F.col("fr") - F.col("im") * F.col("fi")).alias("re"), (F.col("re") * F.col("fi") + F.col("im") * F.col("fr")).alias("im"))
    back = split_transform(product, keys, wide, rows, inverse=True).filter(n < length)
    out = times(back, chirp(n, -1.0))
    return out.withColumns({"re": F.col("re") / wide, "im": F.col("im") / wide})


def power_spectrum_blocks(df: DataFrame, keys: list[str], length: int, t: str = "t", value: str = "value", dx: float = 1.0, block: int = BLOCK) -> DataFrame:
    """As :func:`tidegrid.operators.spectrum.power_spectrum` without smoothing, for series of ``length`` steps in tasks of about ``block`` values.

    Times are integers in steps of one, each at most once. A series with another number of times or with a gap has NULL.
    """
    stats = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.min(t).alias("_first"), F.max(t).alias("_last"), F.avg(value).alias("_mean"))
    whole = (F.col("_n") == length) & (F.col("_last") - F.col("_first") == length - 1)
    stats = checked_side(stats.withColumn("_whole", whole))
    rows = df.join(stats.filter("_whole"), keys).select(*keys, (F.col(t) - F.col("_first")).cast("long").alias("n"), (F.col(value) - F.col("_mean")).alias("re"), F.lit(0.0).alias("im"))
    z = long_transform(rows, keys, length, block).filter(F.col("n") <= length // 2)
    power = z.select(*keys, F.col("n").cast("int").alias("k"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_p"))
    total = checked_side(power.groupBy(*keys).agg(F.sum("_p").alias("_total")))
    out = power.join(total, keys).select(*keys, "k", (F.col("k") / (length * dx)).alias("freq"), F.try_divide("_p", "_total").alias("power"))
    none = F.explode(F.sequence(F.lit(0), F.lit(length // 2))).alias("k")
    gaps = stats.filter("not coalesce(_whole, false)").select(*keys, none).select(*keys, "k", (F.col("k") / (length * dx)).alias("freq"), F.lit(None).cast("double").alias("power"))
    return out.unionByName(gaps)
