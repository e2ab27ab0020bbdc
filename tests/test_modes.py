import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_fields import MONTHS, START, make_field

from tidegrid.operators import anomaly as A
from tidegrid.operators import filters as B
from tidegrid.operators import gram as G
from tidegrid.operators import modes as M
from tidegrid.plans.experiment import run_experiment


def matrix(pdf):
    return pdf.pivot_table(index="month_idx", columns=["member", "lat_i", "lon_i"], values="value").to_numpy()


def test_components_match_a_singular_value_decomposition(spark):
    df, pdf = make_field(spark, members=2)
    pcs = M.principal_components(df, [], A.CELL, 3)
    x = matrix(pdf)
    xc = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    var = pcs.variance.orderBy("mode").toPandas()
    assert var.variance.to_numpy() == pytest.approx(s[:3] ** 2 / (MONTHS - 1))
    assert var.share.to_numpy() == pytest.approx(s[:3] ** 2 / (s**2).sum())
    scores = pcs.scores.toPandas().pivot(index="month_idx", columns="mode", values="value").to_numpy()
    assert np.abs(scores) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-8)
    again = pcs.transform(df).toPandas().pivot(index="month_idx", columns="mode", values="value").to_numpy()
    assert again == pytest.approx(scores, abs=1e-8)
    w = pcs.loadings.toPandas().pivot_table(index=A.CELL, columns="mode", values="w").to_numpy()
    assert w.T @ w == pytest.approx(np.eye(3), abs=1e-8)
    back = pcs.reconstruct(df, pcs.scores).toPandas()
    want = (u[:, :3] * s[:3]) @ vt[:3] + x.mean(axis=0)
    assert matrix(back.assign(value=back.decoded)) == pytest.approx(want, abs=1e-8)


def test_components_by_group_and_projection_is_idempotent(spark):
    df, pdf = make_field(spark, members=2)
    pcs = M.principal_components(df, ["member"], M.GRID, 2)
    x = matrix(pdf[pdf.member == 1])
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    got = pcs.variance.filter("member = 1").orderBy("mode").toPandas().variance.to_numpy()
    assert got == pytest.approx(s[:2] ** 2 / (MONTHS - 1))
    decoded = pcs.reconstruct(df, pcs.scores).select("member", "lat_i", "lon_i", "month_idx", F.col("decoded").alias("value"))
    once = pcs.scores.toPandas().set_index(["member", "mode", "month_idx"]).value
    twice = pcs.transform(decoded).toPandas().set_index(["member", "mode", "month_idx"]).value
    assert (once - twice).abs().max() < 1e-8


def test_ensemble_of_fits_against_direct_fits(spark):
    from tidegrid.functions.kernels import draw_positions

    df, pdf = make_field(spark, members=1)
    fits = spark.createDataFrame([(3, 1), (4, 0)], "seed int, split int")
    got = M.fit_ensemble(df, fits, M.GRID, 2).toPandas()
    x = matrix(pdf)
    for seed, split in ((3, 1), (4, 0)):
        train = np.flatnonzero(np.arange(MONTHS) % 5 != split)
        picked = train[draw_positions(1, len(train), len(train), seed * 104729 + split)[0]]
        sample = x[picked] - x[picked].mean(axis=0)
        s = np.linalg.svd(sample, compute_uv=False)
        var = got[(got.seed == seed)].sort_values("mode").variance.to_numpy()
        assert var == pytest.approx(s[:2] ** 2 / (len(picked) - 1))


def test_gram_of_groups(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(int(i % 2), [float(a) for a in row]) for i, row in enumerate(v)], "g int, vec array<double>").repartition(5)
    got = G.correlations(df, "vec", ["g"]).filter("g = 1").orderBy("i", "j").toPandas().r.to_numpy().reshape(3, 3)
    assert got == pytest.approx(np.corrcoef(v[1::2].T))


def test_variance_shares_sum_to_one(spark):
    df, pdf = make_field(spark, members=2, trend=False)
    loadings = df.select("lat_i", "lon_i").distinct().withColumn("mode", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("w", F.cos(F.col("mode") * F.col("lon_i") + F.col("lat_i")))
    series = M.encode(df, loadings, [1, 2], ["member"])
    shares = M.variance_shares(series, loadings, [1, 2], ["member"]).toPandas()
    assert shares.groupby("member").share.sum().to_numpy() == pytest.approx(1)
    eff = M.effective_modes(shares_df(spark, shares), ["member"]).toPandas()
    assert ((eff.effective >= 1) & (eff.effective <= 1.5)).all()


def shares_df(spark, pdf):
    return spark.createDataFrame(pdf[["member", "mode", "share"]])


def test_signs_follow_the_reference(spark):
    rows = [("a", t, float(np.sin(t))) for t in range(20)] + [("b", t, float(-np.sin(t))) for t in range(20)]
    s = spark.createDataFrame(rows, "mode string, month_idx int, value double").withColumn("g", F.lit(1))
    ref = s.filter("mode = 'a'").drop("mode")
    signs = M.sign_table(s, ref, ["g"])
    assert {r.mode: r.sign for r in signs.collect()} == {"a": 1.0, "b": -1.0}
    flipped = M.apply_signs(s, signs, ["g"]).filter("mode = 'b' and month_idx = 1").first()
    assert flipped.value == pytest.approx(np.sin(1))


def test_filters_on_gappy_and_repeated_rows(spark):
    df, pdf = make_field(spark, members=1, trend=False)
    whole = B.low_pass(df, A.CELL, 24).toPandas()
    twice = B.low_pass(df.union(df), A.CELL, 24).toPandas()
    a, b = (d.sort_values([*A.CELL, "month_idx"]).value.to_numpy() for d in (whole, twice))
    assert a == pytest.approx(b)
    holed = df.withColumn("value", F.when((F.col("lat_i") == 0) & (F.col("month_idx") == START), None).otherwise(F.col("value")))
    out = B.low_pass(holed, A.CELL, 24).toPandas()
    assert out[out.lat_i == 0].value.isna().all() and out[out.lat_i == 1].value.notna().all()


def test_experiment_end_to_end(spark):
    df, _ = make_field(spark, members=1, months=120)
    nodes = df.select(*A.CELL, "lat", "lon").distinct()
    out = run_experiment(df, START + 96, A.CELL, nodes, {"lat": (-20, 20), "lon": (0, 60)}, steps=2, k=2).toPandas()
    assert set(out.kind) == {"train", "val", "test"} and set(out["mode"]) == {"Decadal", "Interannual"}
    assert out.groupby("kind").month_idx.nunique().to_dict() == {"train": 96, "val": 96, "test": 24}
    # each held-out month is encoded once per recursion and mode
    val = out[out.kind == "val"].groupby(["recursion", "mode", "month_idx"]).size()
    assert (val == 1).all() and len(val) == 2 * 2 * 96


def test_wave_band_equals_the_two_dimensional_transform(spark):
    import pandas as pd

    from tidegrid.functions.kernels import wave_filter

    rng = np.random.default_rng(9)
    x = rng.normal(size=(3, 10, 97))
    rows = [(i, j, t, float(x[i, j, t])) for i in range(3) for j in range(10) for t in range(97) if (i, j, t) != (2, 4, 50)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["lat_i", "lon_i", "t", "value"])).repartition(6)
    for wave, smooth, curves in (("kelvin", None, False), ("er", 1.0, True), ("mrg", None, True), ("ig1", None, False)):
        got = B.wave_band(df, ["lat_i"], wave, 4, smooth=smooth, dispersion=curves).toPandas()
        assert got[got.lat_i == 2].value.isna().all() and len(got) == 3 * 10 * 97
        for i in (0, 1):
            grid = got[got.lat_i == i].pivot(index="lon_i", columns="t", values="value").to_numpy()
            assert grid == pytest.approx(wave_filter(x[i], 4, wave, smooth, curves), abs=1e-10)


def test_sums_of_many_groups_in_one_batch_are_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(G, "FLUSH_BYTES", 10_000)
    x = np.random.default_rng(4).normal(size=(60, 20))
    rows = [(i % 30, [float(v) for v in r]) for i, r in enumerate(x)]
    make = {}

    class Parts:
        schema = spark.createDataFrame([], "g int, vec array<double>").schema

        def select(self, *_):
            return self

        def mapInPandas(self, fn, _):
            make["partial"] = fn
            raise StopIteration

    with pytest.raises(StopIteration):
        G.gram_matrix(Parts(), "vec", ["g"])
    made = make["partial"](iter([pd.DataFrame(rows, columns=["g", "vec"])]))
    first = next(made)
    assert made.gi_frame.f_locals["held"] <= 4 * 21 * 21 * 8 and len(first) == 21  # a few groups, not all thirty
    assert len(list(made)) == 29
    df = spark.createDataFrame(rows, "g int, vec array<double>").coalesce(1)
    for r in G.gram_matrix(df, "vec", ["g"]).collect():
        v = np.hstack([x[r.g :: 30], np.ones((2, 1))])
        assert np.array(r.gram).reshape(21, 21) == pytest.approx(v.T @ v)


def _groups(spark, sizes, times=12, seed=8):
    """Random cells per group and month, the first cell of a group twice in one month; also a cell without a month and one with a NULL."""
    x = {g: np.random.default_rng(seed + g).normal(size=(n, times)) for g, n in sizes.items()}
    rows = [(g, c, t, float(v)) for g, block in x.items() for c, row in enumerate(block) for t, v in enumerate(row)]
    rows += [(g, 0, 3, float(block[0, 3])) for g, block in x.items()]
    rows += [(g, 1000, t, 5.0 * t) for g in x for t in range(1, times)] + [(g, 1001, t, 7.0 * t if t else None) for g in x for t in range(times)]
    return spark.createDataFrame(rows, "g int, c int, month_idx int, value double").repartition(5), x


@pytest.mark.parametrize("sizes", [{1: 2, 2: 30, 3: 5}, {1: 2, 3: 5}, {2: 30}])
def test_groups_of_few_cells_send_no_matrix_of_times(spark, monkeypatch, sizes):
    """Many small groups with a long time axis filled the disks with a matrix of all pairs of times each."""
    summed = []

    def gram_matrix(df, vector, by):
        summed.extend(r.g for r in df.select("g").distinct().collect())
        return G.gram_matrix(df, vector, by)

    monkeypatch.setattr(M, "gram_matrix", gram_matrix)
    df, x = _groups(spark, sizes)
    pcs = M.principal_components(df, ["g"], ["c"], 2)
    assert summed == [g for g in sizes if g == 2]
    variance, scores = pcs.variance.toPandas().set_index(["g", "mode"]), pcs.scores.toPandas()
    loadings = pcs.loadings.toPandas()
    assert len(variance) == 2 * len(sizes)
    for g, block in x.items():
        u, s, vt = np.linalg.svd(block - block.mean(axis=1, keepdims=True), full_matrices=False)
        sign = np.sign(vt[[0, 1], np.abs(vt[:2]).argmax(axis=1)])
        for i, mode in enumerate(("pc1", "pc2")):
            assert variance.loc[(g, mode)].to_numpy() == pytest.approx([s[i] ** 2 / 11, s[i] ** 2 / (s**2).sum()])
            got = scores[(scores.g == g) & (scores["mode"] == mode)].sort_values("month_idx").value.to_numpy()
            assert got == pytest.approx(sign[i] * s[i] * vt[i], abs=1e-9)
            mine = loadings[(loadings.g == g) & (loadings["mode"] == mode) & (loadings.c > 0)].sort_values("c")
            assert list(mine.c) == list(range(1, len(block))) and mine.w.to_numpy() == pytest.approx(sign[i] * u[1:, i], abs=1e-9)


def test_few_cells_of_the_whole_table_on_a_long_axis(spark):
    """Three thousand times: the matrix of pairs would have nine million values."""
    x = np.random.default_rng(6).normal(size=(3, 3000))
    df = spark.createDataFrame(pd.DataFrame([(c, t, v) for c, row in enumerate(x) for t, v in enumerate(row)], columns=["c", "month_idx", "value"]))
    got = M.principal_components(df, [], ["c"], 3).variance.orderBy("mode").toPandas()
    s = np.linalg.svd(x - x.mean(axis=1, keepdims=True), compute_uv=False)
    assert got.variance.to_numpy() == pytest.approx(s**2 / 2999) and got.share.sum() == pytest.approx(1)


def test_fewer_cells_than_components_and_constant_or_incomplete_groups(spark):
    rows = [(1, c, t, float((c + 1) * (t % 3))) for c in (0, 1) for t in range(6)] + [(2, 0, t, 4.0) for t in range(6)] + [(3, 0, t, 1.0 if t else None) for t in range(6)]
    df = spark.createDataFrame(rows, "g int, c int, month_idx int, value double")
    pcs = M.principal_components(df, ["g"], ["c"], 4)
    got = pcs.variance.toPandas().pivot(index="g", columns="mode", values="variance")
    assert list(got.index) == [1, 2]  # the only cell of the third lacks a value
    want = np.var(np.arange(6) % 3, ddof=1)
    assert got.loc[1].to_numpy() == pytest.approx([5 * want, 0, 0, 0], abs=1e-12) and (got.loc[2] == 0).all()
    assert pcs.variance.filter("g = 2 and share is not null").count() == 0
    assert pcs.scores.count() == 2 * 4 * 6 and pcs.scores.filter("g = 2 and value <> 0 or isnan(value)").count() == 0
    assert M.principal_components(df.filter("false"), ["g"], ["c"], 2).variance.count() == 0
    assert M.principal_components(df.filter("false"), [], ["g", "c"], 2).variance.count() == 0
