"""Components of a long axis next to numpy's singular value decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import long_components as L
from tidegrid.operators.modes import principal_components


def _frame(spark, x):
    """x: cells by times; long rows made in the JVM from arrays."""
    packed = spark.createDataFrame([(i // 10, i % 10, v.tolist()) for i, v in enumerate(x)], "lat_i int, lon_i int, vs array<double>")
    return packed.select("lat_i", "lon_i", F.posexplode("vs").alias("t", "value")).withColumn("value", F.nanvl("value", F.lit(None)))


def _compare(got, x, k, atol=1e-6):
    """Scores, weights and variances against a full decomposition; NaN rows take no part."""
    whole = np.isfinite(x).all(axis=1)
    a = x[whole] - x[whole].mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    scores = np.zeros((k, x.shape[1]))
    for r in got.scores.toPandas().itertuples():
        scores[int(r.mode[2:]) - 1, r.t] = r.value
    scale = s[0]
    for i in range(k):
        want = vt[i] * s[i]
        want = want * np.sign(want[np.abs(want).argmax()])
        assert np.abs(scores[i] - want).max() < atol * scale
    variance = {r.mode: (r.variance, r.share) for r in got.variance.collect()}
    for i in range(k):
        assert variance[f"pc{i + 1}"] == pytest.approx((s[i] ** 2 / (x.shape[1] - 1), s[i] ** 2 / (s**2).sum()), rel=1e-8)
    weights = {(r.lat_i, r.lon_i): (r.mean, r.w) for r in got.weights.collect()}
    assert set(weights) == {(i // 10, i % 10) for i in np.flatnonzero(whole)}
    w = np.array([weights[(i // 10, i % 10)][1] for i in np.flatnonzero(whole)])
    assert np.allclose(w.T @ a, scores, atol=atol * scale)
    assert np.allclose(w.T @ w, np.eye(k), atol=1e-8)


def _noise(cells, times, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(times)
    planted = r.normal(size=(cells, 3)) * [2.0, 1.4, 1.0] @ np.stack([np.sin(t / 500), np.cos(t / 90), np.sin(t / 7)])
    return planted + r.normal(size=(cells, times)) + r.normal(size=(cells, 1)) * 50


def test_twenty_thousand_times(spark):
    x = _noise(60, 20_000)
    _compare(L.long_axis_components(_frame(spark, x), ["lat_i", "lon_i"], 3, t="t"), x, 3)


@pytest.mark.parametrize("block, chunk", [(100, 7), (1000, 1000)])
def test_many_tiles_and_a_basis_that_grows(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "FAN", 2)
    x = _noise(40, 730, 3)
    x[[4, 17], 5] = np.nan
    _compare(L.long_axis_components(_frame(spark, x), ["lat_i", "lon_i"], 2, t="t", block=block, width=4, steps=12), x, 2)


def test_fewer_cells_than_components(spark):
    x = np.vstack([np.sin(np.arange(50.0)), 2 * np.sin(np.arange(50.0)), np.full(50, 3.0)])
    got = L.long_axis_components(_frame(spark, x), ["lat_i", "lon_i"], 3, t="t", block=20)
    variance = [r.variance for r in got.variance.orderBy("mode").collect()]
    assert variance[0] == pytest.approx(5 * np.var(x[0], ddof=1)) and max(variance[1:]) < 1e-12
    assert got.weights.count() == 3 and got.scores.count() == 150


def test_empty_and_constant_fields(spark):
    empty = L.long_axis_components(_frame(spark, np.ones((2, 5))).filter("false"), ["lat_i", "lon_i"], 2, t="t")
    assert empty.scores.count() == empty.weights.count() == 0
    flat = L.long_axis_components(_frame(spark, np.ones((2, 5))), ["lat_i", "lon_i"], 2, t="t")
    assert flat.scores.count() == 0


def test_same_as_the_gram_matrix_on_a_short_axis(spark):
    df = _frame(spark, _noise(15, 60, 5))
    a = L.long_axis_components(df, ["lat_i", "lon_i"], 2, t="t").scores.toPandas().pivot(index="mode", columns="t", values="value")
    b = principal_components(df, [], ["lat_i", "lon_i"], 2, t="t").scores.toPandas().pivot(index="mode", columns="t", values="value")
    assert np.allclose(a, b, atol=1e-6)
