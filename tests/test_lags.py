"""Lagged correlations of all lags at once next to a loop over the lags."""

import numpy as np
import pytest

from tidegrid.operators import lagcorr as L


def _loop(t, x, y, max_lag, step, by_month):
    out = {}
    at = {int(m): (a, b) for m, a, b in zip(t, x, y, strict=True)}
    for lag in range(-max_lag, max_lag + 1):
        pairs = {}
        for m, (a, _) in at.items():
            b = at.get(m + lag * step, (None, None))[1]
            if a is not None and b is not None:
                pairs.setdefault(m % 12 + 1 if by_month else 1, []).append((a, b))
        for month, p in pairs.items():
            p = np.array(p)
            varies = len(p) > 1 and np.ptp(p[:, 0]) > 0 and np.ptp(p[:, 1]) > 0
            out[(month, lag)] = (len(p), np.corrcoef(p.T)[0, 1] if varies else None)
    return out


@pytest.mark.parametrize("many", [1, 10_000])
@pytest.mark.parametrize("by_month, step", [(False, 1), (True, 1), (True, 5)])
def test_sums_of_all_lags_are_those_of_a_loop(spark, monkeypatch, many, by_month, step):
    r = np.random.default_rng(3)
    months = sorted(r.choice(np.arange(-40, 160), 150, replace=False).tolist())
    x = [float(v) if r.random() > 0.1 else None for v in r.normal(size=150) + 1e5]
    y = [float(v) if r.random() > 0.1 else None for v in np.round(r.normal(size=150))]
    ds = [spark.createDataFrame([(1, m, v) for m, v in zip(months, s)], "k int, month_idx int, value double") for s in (x, y)]
    monkeypatch.setattr(L, "MANY_LAGS", many)
    monkeypatch.setattr(L, "BLOCK_VALUES", 1000)
    run = L._correlate(*ds, ["k"], 170, step, by_month).collect()
    got = {(row.month if by_month else 1, row.lag): (row.n, row.r) for row in run}
    want = _loop(months, x, y, 170, step, by_month)
    assert set(want) <= set(got) and all(got[k][0] == 0 and got[k][1] is None for k in set(got) - set(want))
    for key, (n, value) in want.items():
        assert got[key][0] == n
        if value is not None and abs(value) < 1 - 1e-9:
            assert got[key][1] == pytest.approx(value, abs=1e-8)


def test_ten_thousand_lags(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=20_000)
    y = np.roll(x, 7000) + 0.5 * r.normal(size=20_000)
    ds = [spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(s) if i % 11], "k int, month_idx int, value double") for s in (x, y)]
    out = L.cross_correlation(*ds, ["k"], 10_000)
    rows = {v.lag: (v.n, v.r) for v in out.collect()}
    assert len(rows) == 20_001 and max(rows, key=lambda k: rows[k][1]) == 7000
    keep = np.arange(20_000) % 11 > 0
    for lag in (-9999, -1, 0, 3, 7000, 10_000):
        i = np.arange(max(0, -lag), 20_000 - max(0, lag))
        i = i[keep[i] & keep[i + lag]]
        assert rows[lag] == (len(i), pytest.approx(np.corrcoef(x[i], y[i + lag])[0, 1], abs=1e-9))


def test_constant_and_empty_series(spark):
    c = spark.createDataFrame([(1, m, 5.0) for m in range(40)], "k int, month_idx int, value double")
    assert L.cross_correlation(c, c, ["k"], 5).filter("r is not null").count() == 0
    assert L.cross_correlation(c, c, ["k"], 600).filter("r is not null").count() == 0
    assert L.cross_correlation(c.filter("false"), c, ["k"], 5).count() == 0
