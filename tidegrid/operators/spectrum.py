"""Power spectra of series and measures on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.coords import gaussian_weights
from tidegrid.functions.kernels import power_share, reflect_smooth
from tidegrid.operators.series_kernels import array_kernel, pack_series


def power_spectrum(df: DataFrame, keys: list[str], t: str = "month_idx", value: str = "value", dx: float = 1.0, smooth: int = 0) -> DataFrame:
    """Share of power per frequency of each gap-free series: rows ``(*keys, k, freq, power)``.

    ``smooth`` is the width of a reflected Gaussian moving mean over power and frequencies,
    after which the power is scaled to sum 1 again.
    """
    weights = gaussian_weights(smooth) if smooth else [1.0]

    def power(x: np.ndarray) -> np.ndarray:
        p = reflect_smooth(power_share(x), weights)
        with np.errstate(invalid="ignore"):
            return p / p.sum(axis=1, keepdims=True)

    def freq(x: np.ndarray) -> np.ndarray:
        f = reflect_smooth(np.fft.rfftfreq(x.shape[1], d=dx)[None, :], weights)
        return np.repeat(f, len(x), axis=0)

    packed = pack_series(df, keys, t, value, even=True)
    both = packed.select(*keys, array_kernel(power)("vs").alias("p"), array_kernel(freq)("vs").alias("f"))
    return both.select(*keys, F.posexplode(F.arrays_zip("p", "f")).alias("k", "z")).select(
        *keys, "k", F.col("z.f").alias("freq"), F.col("z.p").alias("power")
    )


def fourier_power(df: DataFrame, keys: list[str], n: int, t: str = "t", value: str = "value") -> DataFrame:
    """Power by plain sums of cosines and sines, for short series; steps ``t`` run from 0 to n - 1."""
    z = df.select(*keys, t, value, F.explode(F.sequence(F.lit(1), F.lit(n // 2))).alias("k"))
    angle = 2 * F.pi() * F.col("k") * F.col(t) / n
    sums = z.groupBy(*keys, "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(F.col(value) * F.sin(angle)).alias("im"))
    return sums.select(*keys, "k", "re", "im", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def spectral_summary(spec: DataFrame, keys: list[str], steps_per_year: int = 12) -> DataFrame:
    """Peak period and inverse mean frequency in years, and the spread in frequency."""
    out = spec.groupBy(*keys).agg(
        F.max_by("freq", F.struct(F.col("power"), (-F.col("k")).alias("first"))).alias("peak"),
        F.sum(F.col("freq") * F.col("power")).alias("mean"),
        F.sum(F.col("freq") * F.col("freq") * F.col("power")).alias("square"),
    )
    return out.select(
        *keys,
        (F.try_divide(F.lit(1.0), "peak") / steps_per_year).alias("peak_period"),
        (F.try_divide(F.lit(1.0), "mean") / steps_per_year).alias("mean_period"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("spread"),
    )


def cumulative_power(spec: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return spec.withColumn("cumulative", F.sum("power").over(w))


def spectral_overlap(spec: DataFrame, by: list[str], modes: list[str]) -> DataFrame:
    """Overlap of the spectra of each mode pair: area under the minimum over area under the maximum.

    The modes of one frequency become columns, so a pair is an expression and not a join. The
    trapezoid rule with unit steps is a sum with the end values halved.
    """
    cols = {f"m{i}": F.max(F.when(F.col("mode") == m, F.col("power"))) for i, m in enumerate(modes)}
    wide = spec.groupBy(*by, "k").agg(*[c.alias(n) for n, c in cols.items()], F.lit(1).alias("_one"))
    last = F.max("k").over(Window.partitionBy(*by))
    wide = wide.withColumn("_w", F.when((F.col("k") == 0) | (F.col("k") == last), 0.5).otherwise(1.0))
    pairs = [(i, j) for i in range(len(modes)) for j in range(len(modes))]

    def area(fn, i, j):
        return F.sum(fn(F.col(f"m{i}"), F.col(f"m{j}")) * F.col("_w"))

    cells = F.array(
        *[
            F.struct(F.lit(modes[i]).alias("mode_a"), F.lit(modes[j]).alias("mode_b"), F.try_divide(area(F.least, i, j), area(F.greatest, i, j)).alias("overlap"))
            for i, j in pairs
        ]
    )
    return wide.groupBy(*by).agg(cells.alias("c")).select(*by, F.explode("c").alias("p")).select(*by, "p.*")


def pair_weights(shares: DataFrame, by: list[str], scheme: str = "mult") -> DataFrame:
    """Weights of the mode pairs from the variance shares: zero on the diagonal, sum 1.

    ``shares`` has one row per group and mode.
    """
    packed = shares.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("mode", "share"))).alias("s"))
    a = packed.select(*by, "s", F.explode("s").alias("a")).select(*by, "a", F.explode("s").alias("b"))
    ra, rb = F.sqrt("a.share"), F.sqrt("b.share")
    raw = F.when(F.col("a.mode") == F.col("b.mode"), 0.0).otherwise(ra * rb if scheme == "mult" else ra + rb)
    out = a.select(*by, F.col("a.mode").alias("mode_a"), F.col("b.mode").alias("mode_b"), raw.alias("w"))
    total = F.sum("w").over(Window.partitionBy(*by)) if by else out.agg(F.sum("w").alias("t")).scalar()
    return out.withColumn("w", F.try_divide(F.col("w"), total))


def off_diagonal(corr: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Absolute correlations with the diagonal removed, raised by a tiny floor."""
    return corr.withColumn("r", F.when(F.col("mode_a") == F.col("mode_b"), 0.0).otherwise(F.abs("r")) + F.lit(floor))


def overlap_score(overlap: DataFrame, weights: DataFrame, loading_corr: DataFrame, by: list[str]) -> DataFrame:
    """Weighted overlap plus the same weighted by how alike the loadings are."""
    pair = ["mode_a", "mode_b"]
    z = overlap.join(weights, [*by, *pair]).join(off_diagonal(loading_corr), [c for c in [*by, *pair] if c in loading_corr.columns])
    return z.groupBy(*by).agg(F.sum(F.col("w") * F.col("overlap") * (1 + F.col("r"))).alias("score"))


def correlation_penalty(corr: DataFrame, shares: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute correlation between modes, weighted by products of variance shares."""
    a = shares.select(*by, F.col("mode").alias("mode_a"), F.col("share").alias("_sa"))
    b = shares.select(*by, F.col("mode").alias("mode_b"), F.col("share").alias("_sb"))
    z = off_diagonal(corr).join(a, [*by, "mode_a"]).join(b, [*by, "mode_b"]).withColumn("_w", F.col("_sa") * F.col("_sb"))
    other = F.sum(F.when(F.col("mode_a") != F.col("mode_b"), F.col("_w")))
    return z.groupBy(*by).agg(F.try_divide(F.sum(F.col("r") * F.col("_w")), other).alias("penalty"))


def centring_penalty(df: DataFrame, by: list[str], keys: list[str], value: str = "value") -> DataFrame:
    """Mean absolute mean of the series."""
    return df.groupBy(*by, *keys).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg(F.abs("m")).alias("penalty"))


def logistic_misfit(spec: DataFrame, keys: list[str], fit_power: int = 2) -> DataFrame:
    """Distance between a spectrum and the bell whose running sum is a fitted logistic curve.

    The logit of the cumulative power is regressed on powers of an even grid over [-5, 5]; the
    fitted sigmoid ``s`` gives the bell ``s (1 - s)``, scaled to sum 1.
    """

    def misfit(p: np.ndarray) -> np.ndarray:
        x = np.vander(np.linspace(-5, 5, p.shape[1]), fit_power, increasing=True)
        cum = np.cumsum(p, axis=1) * (1 - 1e-5)
        fit = (x @ (np.linalg.pinv(x.T @ x) @ (x.T @ np.log(cum / (1 - cum)).T))).T
        s = 1 / (1 + np.exp(-fit))
        bell = s * (1 - s)
        return np.abs(p - bell / bell.sum(axis=1, keepdims=True)).sum(axis=1, keepdims=True)

    packed = pack_series(spec, keys, "k", "power")
    return packed.select(*keys, F.element_at(array_kernel(misfit)("vs"), 1).alias("misfit"))


def window_cuts(n: int, first_divisor: int = 1) -> list[tuple[int, int]]:
    """(start, stop) of the windows of halving widths above 10, each width with a tail window."""
    cuts, width = [], n // first_divisor // 2
    while width > 10:
        cuts += [(start, start + width) for start in range(0, n - width - 1, width)]
        cuts.append((n - width - 1, n))
        width //= 2
    return cuts


def windowed_spectrum_mean(df: DataFrame, keys: list[str], t: str = "month_idx", value: str = "value", dx: float = 5.0, first_divisor: int = 1) -> DataFrame:
    """Mean of peak-scaled spectra of windows of many widths, as one number per series."""

    def measure(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        x = x - x.mean(axis=1, keepdims=True)
        axis = np.fft.rfftfreq(n, d=dx)
        cuts = window_cuts(n, first_divisor)
        total = np.zeros((len(x), len(axis)))
        for start, stop in cuts:
            freq = np.fft.rfftfreq(stop - start, d=dx)
            power = np.abs(np.fft.rfft(x[:, start:stop], axis=1)) ** 2
            on_axis = np.vstack([np.interp(axis, freq, p) for p in power])
            total += on_axis / on_axis.max(axis=1, keepdims=True)
        return (total / len(cuts)).mean(axis=1, keepdims=True)

    packed = pack_series(df, keys, t, value, even=True)
    return packed.select(*keys, F.element_at(array_kernel(measure)("vs"), 1).alias("measure"))


def order_by_period(summary: DataFrame, by: list[str], labels: tuple[str, ...]) -> DataFrame:
    """Modes ranked by peak period, longest first, with their labels; ties by name."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("peak_period").desc(), F.col("mode"))
    out = summary.withColumn("rank", F.row_number().over(w))
    return out.withColumn("label", F.try_element_at(F.lit(list(labels)), F.col("rank")))


def frequency_axis(n: int, dx: float = 1.0) -> Column:
    """Frequencies of a real transform of ``n`` steps, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: k / (n * dx))
