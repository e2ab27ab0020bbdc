"""Temporal and wavenumber-frequency filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.kernels import Box, butterworth, gaussian_smooth, kept_frequencies, spectral_box, wave_keep, zero_phase
from tidegrid.functions.quantiles import sorted_quantiles
from tidegrid.functions.sizing import checked_side
from tidegrid.operators.series_kernels import apply_per_series, heavy, pack_series
from tidegrid.session import cut_lineage

ORDER = 4


def _filtered(df, keys, kind, periods, t, value, method, unique):
    if method == "fft":
        # a period of p steps is a frequency of 1 / p
        low = None if kind == "low" else 1 / periods[0]
        high = None if kind == "high" else 1 / periods[-1]
        return apply_per_series(df, keys, lambda x: spectral_box(x, low, high), t, value, unique)
    cutoff = [2.0 / p for p in periods]
    b, a = butterworth(ORDER, cutoff, kind)
    return apply_per_series(df, keys, lambda x: zero_phase(x, b, a), t, value, unique)


def low_pass(df: DataFrame, keys: list[str], period: float = 84, t: str = "month_idx", value: str = "value", method: str = "butter", unique: bool = False) -> DataFrame:
    """Keep variations longer than ``period`` steps (7 years of months by default).

    Fourth-order Butterworth run forwards and backwards, or a spectral box (``method="fft"``).
    A series with a gap gives NULL; one shorter than the padding is an error.
    """
    return _filtered(df, keys, "low", [period], t, value, method, unique)


def high_pass(df: DataFrame, keys: list[str], period: float = 36, t: str = "month_idx", value: str = "value", method: str = "butter", unique: bool = False) -> DataFrame:
    """Keep variations shorter than ``period`` steps (3 years of months by default)."""
    return _filtered(df, keys, "high", [period], t, value, method, unique)


def band_pass(
    df: DataFrame, keys: list[str], longest: float = 84, shortest: float = 36, t: str = "month_idx", value: str = "value", method: str = "butter", unique: bool = False
) -> DataFrame:
    """Keep variations between ``shortest`` and ``longest`` steps, along time whatever the key order."""
    return _filtered(df, keys, "band", [longest, shortest], t, value, method, unique)


_DOUBLES = T.ArrayType(T.DoubleType())
_COEF = T.StructType([T.StructField("re", _DOUBLES), T.StructField("im", _DOUBLES)])


@dataclass(frozen=True)
class Axis:
    """Steps of an integer axis, against which a slice is proved complete."""

    start: int
    step: int
    size: int

    def values(self, kind: T.DataType) -> Column:
        """All steps, as an array of the axis' own type."""
        first, last = (F.lit(v).cast(kind) for v in (self.start, self.start + self.step * (self.size - 1)))
        return F.sequence(first, last, F.lit(self.step).cast(kind))


def found_axis(df: DataFrame, column: str) -> Axis:
    """From the first to the last step of a table by the smallest distance of two; only the distinct steps are gathered."""
    steps = df.agg(F.sort_array(F.collect_set(column)).alias("a"))
    n = F.size("a")
    gaps = F.zip_with(F.slice("a", 2, F.greatest(n - 1, F.lit(0))), F.slice("a", 1, F.greatest(n - 1, F.lit(0))), lambda x, y: x - y)
    row = steps.select(F.array_min("a").alias("first"), F.array_max("a").alias("last"), F.coalesce(F.array_min(gaps), F.lit(1)).alias("step")).first()
    return Axis(0, 1, 0) if row.first is None else Axis(int(row["first"]), int(row["step"]), (int(row["last"]) - int(row["first"])) // int(row["step"]) + 1)


def _rows_of(lists: pd.Series, width: int) -> np.ndarray:
    """Lists as rows of a matrix; NULL gives NaN."""
    return np.vstack([np.full(width, np.nan) if v is None else np.asarray(v, dtype=float) for v in lists]) if len(lists) else np.empty((0, width))


def wave_band(
    df: DataFrame,
    by: list[str],
    wave: str,
    obs_per_day: float = 1.0,
    lon: str = "lon_i",
    t: str = "t",
    value: str = "value",
    smooth: float | None = None,
    dispersion: bool = False,
    box: Box | None = None,
    times: Axis | None = None,
    longitudes: Axis | None = None,
) -> DataFrame:
    """Wavenumber-frequency box of a wave preset on every longitude-time slice.

    The two-dimensional transform is separable: first along time (a task holds one series), then
    along longitude for each kept frequency (a circle of longitudes), then back. So no slice is
    ever gathered, and only the kept frequencies take part in the second and third exchange.

    Axes are declared (``times``, ``longitudes``) or else found: evenly from the first to the last step of the whole table. A slice
    that lacks a step of either axis, or a value there, gives NULL at every step, also where the step is absent in the whole
    table. ``smooth`` is a Gaussian along longitude first; ``dispersion`` also applies the dispersion curve of the wave; ``box`` takes the
    place of the preset's ranges (see :data:`tidegrid.functions.kernels.WAVES`).
    """
    name = wave.lower()
    times, around = times or found_axis(df, t), longitudes or found_axis(df, lon)
    n, n_lon = times.size, around.size
    if not n or not n_lon:
        return df.select(*by, lon, t, F.col(value).cast("double").alias(value)).filter("false")
    kept = kept_frequencies(n, obs_per_day, name, box)

    @heavy
    @F.pandas_udf(_COEF)
    def to_frequency(vs: pd.Series) -> pd.DataFrame:
        out = [np.fft.rfft(_rows_of(vs.iloc[i : i + 512], n), axis=1)[:, kept] for i in range(0, len(vs), 512)]
        return pd.DataFrame({"re": [r for c in out for r in c.real], "im": [r for c in out for r in c.imag]})

    @heavy
    @F.pandas_udf(_COEF)
    def across_longitudes(re: pd.Series, im: pd.Series, at: pd.Series) -> pd.DataFrame:
        mask = wave_keep(n_lon, n, obs_per_day, name, dispersion, box)[:, kept].T
        out = []
        for i in range(0, len(re), 4096):
            a, b = (_rows_of(x.iloc[i : i + 4096], n_lon) for x in (re, im))
            if smooth is not None:
                a, b = gaussian_smooth(a.T, smooth).T, gaussian_smooth(b.T, smooth).T
            out.append(np.fft.ifft(np.where(mask[at.iloc[i : i + 4096].to_numpy()], np.fft.fft(a + 1j * b, axis=1), 0), axis=1))
            out[-1][~np.isfinite(a).all(axis=1)] = np.nan
        return pd.DataFrame({"re": [r for c in out for r in c.real], "im": [r for c in out for r in c.imag]})

    @heavy
    @F.pandas_udf(_DOUBLES)
    def to_time(re: pd.Series, im: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(re), 512):
            a, b = (_rows_of(x.iloc[i : i + 512], len(kept)) for x in (re, im))
            spec = np.zeros((len(a), n // 2 + 1), dtype=complex)
            spec[:, kept] = a + 1j * b
            found = np.fft.irfft(spec, n=n, axis=1)
            found[~np.isfinite(a).all(axis=1)] = np.nan
            out.extend(found)
        return pd.Series(out, dtype=object)

    packed = pack_series(df, [*by, lon], t, value)
    whole = F.when(F.col("ts") == times.values(df.schema[t].dataType), F.col("vs"))
    freq = packed.select(*by, lon, to_frequency(whole).alias("_c")).select(*by, lon, F.posexplode(F.arrays_zip("_c.re", "_c.im")).alias("_at", "_z"))
    circle = freq.groupBy(*by, "_at").agg(F.sort_array(F.collect_list(F.struct(F.col(lon).alias("x"), "_z.re", "_z.im"))).alias("_s"))
    # a circle with an absent longitude has other wavenumbers: it counts as a gap
    full = F.col("_s.x") == around.values(df.schema[lon].dataType)
    filtered = across_longitudes(F.when(full, F.col("_s.re")), F.when(full, F.col("_s.im")), "_at")
    back = circle.select(*by, "_at", filtered.alias("_c")).select(*by, "_at", F.explode(F.arrays_zip(around.values(df.schema[lon].dataType).alias("x"), F.col("_c.re"), F.col("_c.im"))).alias("_z"))
    series = back.groupBy(*by, F.col("_z.x").alias(lon)).agg(F.sort_array(F.collect_list(F.struct("_at", "_z.re", "_z.im"))).alias("_s"))
    out = series.select(*by, lon, to_time(F.col("_s.re"), F.col("_s.im")).alias("_v"))
    rows = out.select(*by, lon, F.explode(F.arrays_zip(times.values(df.schema[t].dataType).alias("t"), F.col("_v").alias("v"))).alias("_z"))
    return rows.select(*by, lon, F.col("_z.t").alias(t), F.nanvl(F.col("_z.v"), F.lit(None).cast("double")).alias(value))


def event_mask(filtered: DataFrame, by: list[str], percentile: float | None = None, threshold: float | None = None, value: str = "value") -> DataFrame:
    """1 where the filtered amplitude exceeds a threshold, else 0; also returns the threshold.

    A percentile is taken over the positive amplitudes of each slice, exactly and by a
    distributed sort.
    """
    size = filtered.withColumn("_a", F.abs(value))
    if threshold is None:
        if percentile is None or not 0 < percentile < 1:
            raise ValueError("the percentile must lie between 0 and 1")
        # the filter is the costly part: its result is stored, not run for the threshold and again
        size = cut_lineage(size)
        bound = sorted_quantiles(size.filter(F.col("_a") > 0), by, "_a", [percentile]).select(*by, F.col("quantile").alias("threshold"))
        size = size.join(checked_side(bound), by)
    else:
        size = size.withColumn("threshold", F.lit(float(threshold)))
    return size.withColumn("event", F.when(F.col("_a") > F.col("threshold"), 1).otherwise(0)).drop("_a")
