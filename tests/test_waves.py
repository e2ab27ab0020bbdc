"""Wave filters against the two-dimensional transform, on declared and found axes."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.kernels import wave_box, wave_filter
from tidegrid.operators import filters as B
from tidegrid.operators.series_kernels import pack_series
from tidegrid.plans import fixtures as X

LON, TIMES = 12, 96


@pytest.fixture(scope="module")
def slices(spark):
    x = np.random.default_rng(8).normal(size=(2, LON, TIMES))
    rows = [(g, 5 * i, 6 * t, float(x[g, i, t])) for g in range(2) for i in range(LON) for t in range(TIMES)]
    return x, spark.createDataFrame(rows, "g int, lon_i int, t long, value double")


def _grid(out, g):
    grid = np.full((LON, TIMES), np.inf)
    for r in out.filter(F.col("g") == g).collect():
        grid[r.lon_i // 5, r.t // 6] = np.nan if r.value is None else r.value
    return grid


@pytest.mark.parametrize("wave, box", [("kelvin", None), ("er", None), ("ig1", None), ("mrg", (2, 6, -5, 5, 8, 90)), ("ig0", (1.5, 6, 1, 5, 8, 90)), ("ig2", (0.8, 2, -5, -1, 12, 90)), ("mjo", None)])
def test_every_curve_is_that_of_the_whole_transform(spark, slices, wave, box):
    x, df = slices
    out = B.wave_band(df, ["g"], wave, 4, dispersion=True, box=box)
    for g in range(2):
        assert _grid(out, g) == pytest.approx(wave_filter(x[g], 4, wave, None, True, box), abs=1e-10)


def test_waves_without_a_preset_need_a_box():
    with pytest.raises(ValueError, match="give its box"):
        wave_box("ig0", None)


def test_a_step_absent_in_the_whole_table_is_a_gap(spark, slices):
    _, df = slices
    out = B.wave_band(df.filter("t <> 180"), ["g"], "kelvin", 4)
    assert out.count() == 2 * LON * TIMES and out.filter("value is not null").count() == 0
    assert out.filter("t = 180").count() == 2 * LON


def test_absent_ends_show_on_a_declared_axis(spark, slices):
    x, df = slices
    some = df.filter("not (g = 1 and (t = 0 or lon_i = 55))")
    axes = {"times": B.Axis(0, 6, TIMES), "longitudes": B.Axis(0, 5, LON)}
    for rows in (some, some.filter("not (t > 500 and g = 1)"), df.filter("g = 0 or lon_i < 55")):
        out = B.wave_band(rows, ["g"], "kelvin", 4, **axes)
        assert np.isnan(_grid(out, 1)).all() and _grid(out, 0) == pytest.approx(wave_filter(x[0], 4, "kelvin"), abs=1e-10)


def test_gaps_empty_tables_and_times_off_the_axis(spark, slices):
    _, df = slices
    null = df.withColumn("value", F.when(~((F.col("g") == 1) & (F.col("t") == 6) & (F.col("lon_i") == 5)), F.col("value")))
    assert np.isnan(_grid(B.wave_band(null, ["g"], "kelvin", 4), 1)).all()
    assert B.wave_band(df.filter("false"), ["g"], "kelvin", 4).count() == 0
    moved = df.withColumn("t", F.when((F.col("g") == 1) & (F.col("t") == 60), 61).otherwise(F.col("t")))
    out = B.wave_band(moved, ["g"], "kelvin", 4, times=B.Axis(0, 6, TIMES))
    assert np.isnan(_grid(out, 1)).all() and out.count() == 2 * LON * TIMES


def test_zeros_of_the_fixture_are_dealt_by_series(spark, tmp_path, monkeypatch):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(u, "ab"[u % 2], start + datetime.timedelta(hours=7 * k * (u + 1) % 744)) for u in (0, 1, 151, 302) for k in range(9)] + [(None, "a", start), (5, None, None)]
    spark.createDataFrame(rows * 2, "user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    counts = collections.Counter((None if u is None else u // 150, e, None if u is None else u % 12, None if t is None else (t.day - 1) * 24 + t.hour) for u, e, t in rows * 2)
    series = {k[:2] for k in counts}
    every = {(*s, x, t): 0.0 for s in series for x in range(12) for t in range(720)} | counts
    monkeypatch.setattr(X, "TASK_ROWS", 5_000)
    out = X.zonal_hourly(spark, str(tmp_path))
    got = out.collect()
    assert len(got) == len(every) and {tuple(r)[:4]: r.value for r in got} == every
    # series are dealt to more tasks than there are shuffle partitions, and none is exchanged again when it is packed
    assert X.hourly_tasks(spark, str(tmp_path), 8640) == -(-len(series) * 8640 // 5_000) > 4
    plan = pack_series(out, ["member", "mode", "lon_i"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    flat = collections.Counter((m, e, t) for (m, e, _, t), n in counts.items() for _ in range(n))
    want = {(*s, t): 0.0 for s in series for t in range(720)} | flat
    assert {tuple(r)[:3]: r.value for r in X.hourly(spark, str(tmp_path)).collect()} == want
