import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.quantiles import sorted_quantiles
from tidegrid.operators import anomaly as A
from tidegrid.operators import composite as P
from tidegrid.operators import histogram as H
from tidegrid.operators import lagcorr as L
from tidegrid.operators import regression as R
from tidegrid.operators import regrid as I
from tidegrid.operators import select as S
from tidegrid.operators import series as Q
from tidegrid.operators import spectrum as Z

START, MONTHS = 23940, 96


def make_field(spark, seed=0, members=2, n_lat=3, n_lon=4, months=MONTHS, gaps=0.0, trend=True):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(members):
        for i in range(n_lat):
            for j in range(n_lon):
                for t in range(months):
                    if rng.random() >= gaps:
                        v = rng.normal() + (0.01 * t + 0.0002 * t * t if trend else 0) + 2 * np.cos(2 * np.pi * t / 12)
                        rows.append((m, START + t, i, j, -20.0 + 20 * i, 30.0 * j, v))
    pdf = pd.DataFrame(rows, columns=["member", "month_idx", "lat_i", "lon_i", "lat", "lon", "value"]).astype({"member": "int32", "month_idx": "int32", "lat_i": "int32", "lon_i": "int32"})
    return spark.createDataFrame(pdf), pdf


def test_anomalies_average_zero_per_cell_and_month(spark):
    df, _ = make_field(spark, gaps=0.1)
    out = A.anomalies(df, A.CELL).toPandas()
    out["m"] = out.month_idx % 12
    assert out.groupby(["member", "lat_i", "lon_i", "m"]).value.mean().abs().max() < 1e-12


def test_detrend_removes_a_quadratic(spark):
    df, pdf = make_field(spark, members=1)
    exact = df.withColumn("value", 3 + 0.5 * F.col("month_idx") - 1e-4 * F.col("month_idx") * F.col("month_idx"))
    out = A.detrend_cells(exact, A.CELL, 2).toPandas()
    assert out.value.abs().max() < 1e-6
    assert out.slope.iloc[0] == pytest.approx(0.5, rel=1e-6)
    flat = A.global_detrend(exact, ["member"], 2).toPandas()
    assert flat.value.abs().max() < 1e-6


def test_heldout_rows_do_not_change_the_model(spark):
    df, _ = make_field(spark, members=1)
    train, test = S.time_range(df, last=START + 59), S.time_range(df, first=START + 60)
    a = A.AnomalyModel.fit(train, ["member"], A.CELL).transform(test).toPandas()
    b = A.AnomalyModel.fit(train, ["member"], A.CELL).transform(test.withColumn("value", F.col("value") + 1)).toPandas()
    m = a.merge(b, on=[*A.CELL, "month_idx"])
    assert (m.value_y - m.value_x).to_numpy() == pytest.approx(1.0)


def test_box_mean_order_matters_with_gaps(spark):
    rows = [(0, 1, 0, 0, 1.0), (0, 1, 1, 0, 3.0), (0, 1, 0, 1, 10.0)]
    df = spark.createDataFrame(rows, "member int, month_idx int, lat_i int, lon_i int, value double")
    assert A.box_mean(df, ["member", "month_idx"]).first()["value"] == 6.0


def test_complete_cells_and_masks(spark):
    df, pdf = make_field(spark, members=1)
    holed = df.filter(~((F.col("lat_i") == 0) & (F.col("lon_i") == 0) & (F.col("month_idx") == START)))
    assert S.complete_cells(holed, A.CELL).select(*A.CELL).distinct().count() == 11
    mask = spark.createDataFrame([(0, 1), (2, 3)], "lat_i int, lon_i int")
    assert S.mask_cells(df, mask).count() == 2 * MONTHS
    gone = df.withColumn("value", F.when(F.col("lat_i") != 1, F.col("value")))
    assert sorted(r[0] for r in S.drop_empty_axes(gone).select("lat_i").distinct().collect()) == [0, 2]


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"k": "hot", "v": np.round(rng.normal(size=5000), 2)})
    cold = pd.DataFrame({"k": [f"c{i % 7}" for i in range(300)], "v": rng.normal(size=300)})
    pdf = pd.concat([hot, cold, pd.DataFrame({"k": ["one"], "v": [4.0]})])
    got = sorted_quantiles(spark.createDataFrame(pdf).repartition(8), ["k"], "v", [0.0, 0.05, 0.5, 0.975, 1.0]).toPandas()
    for r in got.itertuples():
        assert r.quantile == pytest.approx(np.quantile(pdf[pdf.k == r.k].v, r.prob), abs=1e-12)
    assert len(got) == 9 * 5


def test_regression_against_lstsq(spark):
    df, pdf = make_field(spark, members=1, trend=False)
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"month_idx": np.arange(START, START + MONTHS, dtype="int32"), "a": rng.normal(size=MONTHS), "b": rng.normal(size=MONTHS) + 3})
    pred = spark.createDataFrame(p)
    fit = R.ols(df, pred, ["a", "b"], A.CELL)
    resid = R.residuals(df, pred, fit, ["a", "b"], A.CELL).toPandas()
    x = np.column_stack([np.ones(MONTHS), p.a, p.b])
    for r in fit.toPandas().itertuples():
        y = pdf[(pdf.lat_i == r.lat_i) & (pdf.lon_i == r.lon_i)].sort_values("month_idx").value.to_numpy()
        beta, sse, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert np.asarray(r.coefs) == pytest.approx(beta)
        assert r.r2 == pytest.approx(1 - sse[0] / ((y - y.mean()) ** 2).sum())
        e = resid[(resid.lat_i == r.lat_i) & (resid.lon_i == r.lon_i)].sort_values("month_idx").value.to_numpy()
        assert np.abs(x.T @ e).max() < 1e-8
        assert 0 <= min(r.p_values) and max(r.p_values) <= 1
    holed = df.filter(~((F.col("lat_i") == 0) & (F.col("month_idx") == START)))
    partial = {(r.lat_i, r.lon_i): r.coefs for r in R.ols(holed, pred, ["a", "b"], A.CELL).collect()}
    assert partial[(0, 0)] is None and partial[(1, 1)] is not None
    assert R.ols(holed, pred, ["a", "b"], A.CELL, drop_missing=True).filter("coefs is null").count() == 0


def test_lag_correlation_against_loops(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=120), rng.normal(size=120)
    y[3:] += 2 * x[:-3]  # y follows x by three months
    t = np.arange(START, START + 120)
    keep = rng.random(120) > 0.1
    make = lambda v, ok: spark.createDataFrame(pd.DataFrame({"g": 1, "month_idx": t[ok].astype("int32"), "value": v[ok]}))
    dx, dy = make(x, np.ones(120, bool)), make(y, keep)
    got = L.cross_correlation(dx, dy, ["g"], 6).toPandas().set_index("lag")
    assert got.r.idxmax() == 3
    for lag in (-6, 0, 3):
        pairs = [(x[i], y[i + lag]) for i in range(120) if 0 <= i + lag < 120 and keep[i + lag]]
        assert got.r[lag] == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1]) and got.n[lag] == len(pairs)
    pairs = L.lagged_pairs(dx, dy, ["g"], 6, 2).filter("lag = -2").toPandas()
    assert len(pairs) == keep[:-4].sum()
    monthly = L.cross_correlation_by_month(dx, dy, ["g"], 2).filter("lag = 1 and month = 4").first()
    idx = [i for i in range(119) if t[i] % 12 == 3 and keep[i + 1]]
    assert monthly.n == len(idx) and monthly.r == pytest.approx(np.corrcoef(x[idx], y[[i + 1 for i in idx]])[0, 1])


def test_composites_against_loops(spark):
    from tidegrid.functions.kernels import draw_positions

    df, pdf = make_field(spark, members=1, gaps=0.05, trend=False)
    months = {"warm": [START + 1, START + 5, START + 30], "cold": [START + 2, START + 50]}
    sel = spark.createDataFrame([(k, m) for k, v in months.items() for m in v], "panel string, month_idx int")
    out = P.composites(df, sel, A.CELL, "panel", 64, 0.1).toPandas()
    assert len(out) == 24
    times = np.arange(START, START + MONTHS)
    for r in out.itertuples():
        cell = pdf[(pdf.lat_i == r.lat_i) & (pdf.lon_i == r.lon_i)].set_index("month_idx").value.reindex(times).to_numpy()
        picked = cell[np.isin(times, months[r.panel])]
        assert r.n == np.isfinite(picked).sum()
        if r.n:
            assert r.mean == pytest.approx(np.nanmean(picked))
        means = np.nanmean(cell[draw_positions(64, len(months[r.panel]), MONTHS)], axis=1)
        assert r.lower == pytest.approx(np.nanquantile(means, 0.1)) and r.upper == pytest.approx(np.nanquantile(means, 0.9))


def test_composite_of_all_months_is_the_mean(spark):
    df, pdf = make_field(spark, members=1)
    sel = df.select("month_idx").distinct().withColumn("panel", F.lit("all"))
    out = P.composite_mean(df, sel, A.CELL, ["panel"]).toPandas()
    assert sorted(out["mean"]) == pytest.approx(sorted(pdf.groupby(["lat_i", "lon_i"]).value.mean()))


def test_states_are_strict(spark):
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5])], "mode string, month_idx int, value double")
    got = {r.month_idx: r.state for r in P.quantile_states(s, 0.75).collect()}
    assert got == {0: "-", 1: None, 2: ".", 3: None, 4: "+"}


def test_bilinear_weights(spark):
    nodes = spark.createDataFrame([(0, 0, -13.0, 355.0), (0, 1, 0.0, 30.0), (1, 0, 40.0, 10.0)], "dst_lat_i int, dst_lon_i int, lat double, lon double")
    lat, lon = I.Axis(-20, 20, 3), I.Axis(0, 30, 12)
    w = I.bilinear_weights(nodes, lat, lon).toPandas()
    sums = w.groupby(["dst_lat_i", "dst_lon_i"]).w.sum()
    assert sums.to_numpy() == pytest.approx(1) and (1, 0) not in sums.index
    assert set(w[(w.dst_lat_i == 0) & (w.dst_lon_i == 0)].lon_i) == {11, 0}
    assert len(w[(w.dst_lat_i == 0) & (w.dst_lon_i == 1)]) == 1
    field = spark.range(36).select((F.col("id") % 3).cast("int").alias("lat_i"), F.floor(F.col("id") / 3).cast("int").alias("lon_i"), F.lit(7.0).alias("value"))
    assert [r.value for r in I.apply_weights(field, I.bilinear_weights(nodes, lat, lon), []).collect()] == pytest.approx([7, 7])
    holed = field.filter("not (lat_i = 0 and lon_i = 0)")
    assert I.apply_weights(holed, I.bilinear_weights(nodes, lat, lon), []).filter("dst_lon_i = 0").first().value is None


def test_interpolation_clamps(spark):
    s = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 30.0)], "k int, x double, value double")
    t = spark.createDataFrame([(1, v) for v in (-1.0, 0.5, 2.0, 9.0)], "k int, x double")
    got = {r.x: r.value for r in I.interpolate_onto(s, t, ["k"]).collect()}
    assert got == {-1.0: 10.0, 0.5: 15.0, 2.0: 30.0, 9.0: 30.0}


def test_gap_fill_and_gradient(spark):
    rows = [(1, float(x), v) for x, v in zip([0, 10, 30, 40, 60], [None, 1.0, None, 4.0, None])]
    df = spark.createDataFrame(rows, "k int, lat double, value double")
    got = {r.lat: r.value for r in Q.fill_gaps(df, ["k"]).collect()}
    assert got == {0.0: None, 10.0: 1.0, 30.0: 3.0, 40.0: 4.0, 60.0: None}
    x = np.array([0.0, 1.0, 3.0, 4.0, 8.0])
    v = x**2 + 1
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, v)], "k int, lon double, value double")
    got = [r.gradient for r in Q.gradient(df, ["k"], "lon").orderBy("lon").collect()]
    assert got == pytest.approx(np.gradient(v, x))


def test_histogram_edges_and_agreement(spark):
    rows = [(0, -5.0, 5.0), (0, 5.0, 5.0), (0, 6.0, 0.0), (1, -5.0, 5.0), (1, -5.0, 4.99)]
    h = H.joint_histogram(spark.createDataFrame(rows, "m int, x double, y double"), ["m"], "x", "y")
    got = {(r.m, r.bx, r.by): r.density for r in h.collect()}
    assert got == {(0, 0, 44): 0.5, (0, 44, 44): 0.5, (1, 0, 44): 1.0}
    out = {(r.bx, r.by): r for r in H.histogram_summary(h, ["m"], tolerance=0.4).collect()}
    assert out[(0, 44)]["mean"] == pytest.approx(0.75) and out[(0, 44)]["share"] == 1.0 and out[(0, 44)]["agreed"]
    assert out[(44, 44)]["share"] == 0.0 and out[(44, 44)]["std"] == pytest.approx(0.25)


def test_spectra_sum_to_one_and_find_the_period(spark):
    t = np.arange(240)
    x = np.sin(2 * np.pi * t / 48) + 0.1 * np.sin(2 * np.pi * t / 6)
    df = spark.createDataFrame(pd.DataFrame({"mode": "a", "month_idx": (START + t).astype("int32"), "value": x}))
    spec = Z.power_spectrum(df, ["mode"])
    assert spec.agg(F.sum("power")).first()[0] == pytest.approx(1)
    assert Z.spectral_summary(spec, ["mode"]).first().peak_period == pytest.approx(4.0)
    misfit = [Z.logistic_misfit(Z.power_spectrum(df, ["mode"], smooth=7), ["mode"], p).first().misfit for p in (2, 4)]
    assert all(0 < m < 2 for m in misfit)


def test_degenerate_groups_do_not_stop_a_job(spark):
    """One constant or single-valued group among billions must give NULL, not an error."""
    flat = spark.createDataFrame([("a", t, 2.0) for t in range(40)] + [("b", 7, 1.0)], "mode string, month_idx int, value double")
    assert A.detrend_cells(flat, ["mode"], 2).filter("mode = 'b'").first().value is None
    assert L.cross_correlation(flat, flat, ["mode"], 1).filter("r is not null").count() == 0
    assert sum(r.density / 30 for r in H.density_histogram(flat.filter("mode = 'a'"), ["mode"]).collect()) == pytest.approx(1.0)
    assert H.kernel_density(flat, ["mode"], points=3).filter("density is not null").count() == 0
    spec = Z.power_spectrum(flat, ["mode"], smooth=3)
    assert Z.spectral_summary(spec, ["mode"]).count() >= 1
    pred = spark.createDataFrame([(t, 1.0) for t in range(40)], "month_idx int, p double")
    assert R.ols(flat, pred, ["p"], ["mode"], drop_missing=True).filter("coefs is not null").count() == 0


def test_fold_tables(spark):
    df, _ = make_field(spark, members=1)
    folds = Q.assign_folds(df, 5)
    assert folds.groupBy("fold").agg(F.count_distinct("month_idx").alias("n")).orderBy("fold").toPandas().n.tolist() == [20, 19, 19, 19, 19]
    train = Q.training_folds(folds, 5)
    assert train.filter("split = fold").count() == 0 and train.count() == 4 * df.count()


def test_plateau_and_best_step(spark):
    rows = [(1, e, 10.0 - e) for e in range(30)] + [(2, e, 1.0 + (e % 2)) for e in range(30)]
    m = spark.createDataFrame(rows, "fit int, epoch int, value double")
    got = {r.fit: r for r in Q.plateau_test(m.filter("fit = 1 or epoch < 29"), ["fit"], 6).collect()}
    assert got[1].slope == pytest.approx(-1) and got[1].p_value < 1e-6
    assert {r.fit: r.epoch for r in Q.best_step(m, ["fit"]).collect()} == {1: 29, 2: 0}


def test_bootstrap_by_join_against_rows_of_draws(spark):
    from tidegrid.operators import composite as P

    draw = np.random.default_rng(5)
    rows = [(c, 100 + t, float(draw.normal()) if draw.random() > 0.2 else None) for c in range(3) for t in range(15) if (c, t) != (1, 4)] + [(2, 103, 9.0), (3, 101, None), (None, 105, 1.0)]
    field = spark.createDataFrame(rows, "cell int, month_idx int, value double")
    draws = P.draw_table(spark.createDataFrame([("a", 2), ("b", 5)], "panel string, n int"), 7, F.lit(15))
    out = P.bootstrap_by_join(field, draws, ["cell"], 0.1)
    want = {}
    for p, d in {(r.panel, r.draw) for r in draws.collect()}:
        mult = {r.pos: r.mult for r in draws.collect() if (r.panel, r.draw) == (p, d)}
        for c in (0, 1, 2, 3, None):
            hit = [(v, mult[t - 100]) for k, t, v in rows if k == c and v is not None and t - 100 in mult]
            if hit:
                want.setdefault((p, c), []).append(sum(v * m for v, m in hit) / sum(m for _, m in hit))
    got = {(r.panel, r.cell): (r.lower, r.upper) for r in out.collect()}
    assert got.keys() == want.keys()
    for k, means in want.items():
        assert got[k] == pytest.approx((np.quantile(means, 0.1), np.quantile(means, 0.9)))
