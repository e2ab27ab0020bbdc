"""The cross-validated experiment next to plain numpy: folds by subtraction, resampled fits, members, decodings, resume."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_layout import _exchanges

from tidegrid.plans.experiment import FIT, fold_anomalies, resampled_months, run_fits, split_anomalies, write_experiment
from tidegrid.sources import commits
from tidegrid.sources.layout import store_by_cell

MONTHS, TEST_FROM, FOLDS = 96, 72, 5
GRID = ["lat_i", "lon_i"]


def _field(seed, gaps=0.0):
    """Values (lat, lon, month) with trend, seasons and three planted patterns."""
    r = np.random.default_rng(seed)
    t = np.arange(MONTHS)
    season = r.normal(size=(4, 5, 12)) * 3
    patterns = r.normal(size=(3, 4, 5)) * np.array([3, 2, 1])[:, None, None]
    series = np.stack([np.sin(2 * np.pi * t / p + i) for i, p in enumerate((48, 17, 9))])
    x = np.einsum("klo,kt->lot", patterns, series) + season[:, :, t % 12] + 0.02 * t + 1e-4 * t**2 + r.normal(size=(4, 5, MONTHS)) * 0.1
    x[r.random(x.shape) < gaps] = np.nan
    return x


def _frame(spark, x, member=None):
    rows = [(m, i, j, float(10 * i - 15), float(30 * j), None if np.isnan(x[i, j, m]) else float(x[i, j, m])) for i in range(4) for j in range(5) for m in range(MONTHS)]
    df = spark.createDataFrame(rows, "month_idx int, lat_i int, lon_i int, lat double, lon double, value double")
    return df if member is None else df.withColumn("member", F.lit(member))


def _plain(x, split, deg=2):
    """Anomalies of one split: trend of the area mean and climatology of the training months."""
    t = np.arange(MONTHS)
    train = (t < TEST_FROM) & (t % FOLDS != split)
    w = np.cos(np.radians(10.0 * np.arange(4) - 15))[:, None, None] * np.isfinite(x)
    mean = np.nansum(w * np.nan_to_num(x), axis=(0, 1)) / w.sum(axis=(0, 1))
    fit = np.polyval(np.polyfit(t[train] - 40, mean[train], deg), t - 40)
    flat = x - fit
    out = np.full_like(x, np.nan)
    for m in range(12):
        with np.errstate(all="ignore"):
            n = np.isfinite(flat[:, :, train & (t % 12 == m)]).sum(-1)
            clim = np.where(n > 0, np.nansum(flat[:, :, train & (t % 12 == m)], axis=-1) / np.maximum(n, 1), np.nan)
        out[:, :, t % 12 == m] = flat[:, :, t % 12 == m] - clim[:, :, None]
    return out


@pytest.mark.parametrize("gaps", [0.0, 0.4])
def test_folds_by_subtraction_are_those_of_a_loop(spark, gaps):
    x = _field(1, gaps)
    got = np.full((FOLDS, *x.shape), np.nan)
    kinds = set()
    for r in fold_anomalies(_frame(spark, x), TEST_FROM, GRID).collect():
        got[r.split, r.lat_i, r.lon_i, r.month_idx] = np.nan if r.value is None else r.value
        kinds.add((r.split, r.kind, r.month_idx))
    for split in range(FOLDS):
        assert np.allclose(got[split], _plain(x, split), atol=1e-8, equal_nan=True)
    assert kinds == {(s, "test" if m >= TEST_FROM else "val" if m % FOLDS == s else "train", m) for s in range(FOLDS) for m in range(MONTHS)}


def test_folds_of_a_stored_field_exchange_nothing(spark):
    layout = store_by_cell(_frame(spark, _field(1)), GRID, buckets=3)
    out = split_anomalies(layout, TEST_FROM, GRID)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("FileScan parquet spark_catalog") == 1
    assert _exchanges(out) == []


def test_folds_of_an_empty_field_and_of_no_training_months(spark):
    field = _frame(spark, _field(1))
    assert fold_anomalies(field.filter("false"), TEST_FROM, GRID).count() == 0
    late = fold_anomalies(field, 0, GRID)
    assert late.count() == 5 * 20 * MONTHS and late.filter("value is not null or kind <> 'test'").count() == 0


def test_resampled_months(spark):
    months = spark.createDataFrame([(m, m % FOLDS if m < TEST_FROM else None) for m in range(MONTHS)], "month_idx int, fold int")
    fits = spark.createDataFrame([(i, s) for i in range(3) for s in range(FOLDS)], "initialization int, split int")
    got = {}
    for r in resampled_months(months, fits).collect():
        got.setdefault((r.initialization, r.split), {})[r.pos] = r.month_idx
    for (i, s), sample in got.items():
        train = [m for m in range(TEST_FROM) if m % FOLDS != s]
        assert sorted(sample) == list(range(len(train))) and set(sample.values()) <= set(train)
        assert ([sample[p] for p in range(len(train))] == train) == (i == 0)
    assert len(got) == 15 and got[(1, 0)] != got[(2, 0)]


def _run(spark, members=None, k=3, steps=2):
    x = _field(2)
    field = _frame(spark, x)
    nodes = field.select(*GRID, "lat", "lon").distinct()
    return x, lambda fits: run_fits(field, TEST_FROM, GRID, nodes, {"lat": (-10, 10), "lon": (0, 60)}, fits, members, steps=steps, k=k, smooth=3)


@pytest.fixture(scope="module")
def outputs(spark):
    members = _frame(spark, _field(3), 4).unionByName(_frame(spark, np.where(np.arange(MONTHS) == 7, np.nan, _field(4)), 9))
    x, run = _run(spark, members)
    out = run(spark.createDataFrame([(0, 1), (1, 1)], "initialization int, split int"))
    return x, out.encodings.toPandas(), out.decodings.toPandas()


def test_first_recursion_is_that_of_numpy(outputs):
    x, encodings, decodings = outputs
    anomaly = _plain(x, 1).reshape(20, MONTHS)
    train = [m for m in range(TEST_FROM) if m % FOLDS != 1]
    mean = anomaly[:, train].mean(axis=1, keepdims=True)
    u = np.linalg.svd(anomaly[:, train] - mean, full_matrices=False)[0][:, :3]
    want = u.T @ (anomaly - mean)
    first = encodings[(encodings.initialization == 0) & (encodings.recursion == 0) & (encodings.kind != "member")]
    got = first.pivot(index="mode", columns="month_idx", values="value").to_numpy()
    assert np.allclose(np.sort(np.abs(got).sum(axis=1)), np.sort(np.abs(want).sum(axis=1)), rtol=1e-6)
    whole = decodings[(decodings.initialization == 0) & (decodings.recursion == 0) & decodings.without.isna() & (decodings.kind != "member")]
    cube = np.full((20, MONTHS), np.nan)
    cube[whole.lat_i * 5 + whole.lon_i, whole.month_idx] = whole.value
    assert np.allclose(cube, mean + u @ want, atol=1e-6)
    # held-out decodings without a mode: what all of them lack adds up to the decoding
    val = decodings[(decodings.initialization == 0) & (decodings.recursion == 0) & (decodings.kind == "val")]
    wide = val.assign(without=val.without.fillna("all")).pivot(index=["lat_i", "lon_i", "month_idx"], columns="without", values="value")
    modes = [c for c in wide.columns if c != "all"]
    assert len(modes) == 3
    lost = sum(wide["all"] - wide[m] for m in modes)
    assert np.allclose(lost, wide["all"] - mean[wide.index.get_level_values(0) * 5 + wide.index.get_level_values(1), 0], atol=1e-8)


def test_members_are_encoded_and_gaps_are_null(outputs):
    _, encodings, decodings = outputs
    rows = encodings[encodings.kind == "member"]
    assert set(rows.member) == {4, 9} and len(rows) == 2 * 2 * 2 * 3 * MONTHS
    assert rows[rows.member == 4].value.notna().all()
    gap = rows[(rows.member == 9) & rows.value.isna()]
    assert set(gap.month_idx) == {7} and len(gap) == 2 * 2 * 3
    assert decodings[(decodings.kind == "member") & (decodings.month_idx == 7) & (decodings.member == 9)].value.isna().all()
    assert encodings[encodings.kind != "member"].member.isna().all()


def test_an_experiment_is_resumed(spark, tmp_path):
    _, run = _run(spark, k=2, steps=1)
    work = spark.createDataFrame([(0, s) for s in range(3)], "initialization int, split int")
    calls = []

    def breaking(fits):
        calls.append([tuple(r) for r in fits.collect()])
        if len(calls) == 2:
            raise RuntimeError("the cluster is gone")
        return run(fits)

    with pytest.raises(RuntimeError):
        write_experiment(work, breaking, str(tmp_path), at_once=1)
    assert write_experiment(work, breaking, str(tmp_path), at_once=2) == 2
    assert calls == [[(0, 0)], [(0, 1)], [(0, 1), (0, 2)]]
    rows = commits.read_done(spark, f"{tmp_path}/encodings", FIT)
    assert rows.groupBy("split").count().filter(f"count <> {2 * MONTHS}").count() == 0 and rows.select("split").distinct().count() == 3
