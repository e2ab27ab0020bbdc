"""Rows, months and digits that must not get lost on the way."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import anomaly as A
from tidegrid.operators import select as S
from tidegrid.operators.filters import low_pass, wave_band
from tidegrid.operators.gram import correlation_table
from tidegrid.operators.lagcorr import cross_correlation
from tidegrid.operators.modes import principal_components
from tidegrid.operators.regression import ols
from tidegrid.operators.spectrum import power_spectrum
from tidegrid.schema import mode_labels
from tidegrid.sources.readers import parse_index_lines
from tidegrid.sources.writers import done_keys


def test_months_before_the_calendar_are_kept(spark):
    field = spark.createDataFrame([(-5, 1.0), (10, 2.0), (130_000, 3.0)], "month_idx int, value double")
    some = spark.createDataFrame([(-5,), (130_000,), (-5,)], "month_idx int")
    assert {r.month_idx for r in S.at_months(field, some).collect()} == {-5, 130_000}
    assert {r.month_idx for r in S.without_months(field, some).collect()} == {10}


def test_a_repeated_month_of_a_predictor_is_an_error(spark):
    field = spark.createDataFrame([(0, m, float(m)) for m in range(6)], "cell int, month_idx int, value double")
    twice = spark.createDataFrame([(m, float(m % 3)) for m in (*range(6), 2)], "month_idx int, p double")
    with pytest.raises(Exception, match="month_idx is repeated: 2"):
        ols(field, twice, ["p"], ["cell"]).collect()


def test_modes_beyond_the_named_ones_have_labels():
    assert mode_labels(3) == ("Decadal", "Interannual", "Quasibiennial")
    assert mode_labels(7)[4:] == ("HF2", "mode6", "mode7")


def test_a_month_without_climatology_gives_null(spark):
    train = spark.createDataFrame([(0, m, 10.0, m * 1.0) for m in range(48) if m % 12 != 5], "cell int, month_idx int, lat double, value double")
    held = spark.createDataFrame([(0, m, 10.0, m * 1.0) for m in range(48, 60)], "cell int, month_idx int, lat double, value double")
    model = A.AnomalyModel.fit(train.withColumn("g", F.lit(1)), ["g"], ["g", "cell"], 1)
    got = {r.month_idx: r.value for r in model.transform(held.withColumn("g", F.lit(1))).collect()}
    assert len(got) == 12 and [m for m, v in got.items() if v is None] == [53]


def test_index_lines_of_a_year_that_is_not_over(spark):
    lines = spark.createDataFrame([("1999 " + " ".join(str(i) for i in range(12)),), ("2000 5 6 7",), ("header line",), ("2001",)], "value string")
    got = {r.month_idx: r.value for r in parse_index_lines(lines).collect()}
    assert len(got) == 24 and got[2000 * 12 + 2] == 7 and got[2000 * 12 + 3] is None


def test_lags_beyond_the_span_have_no_pairs(spark):
    x = spark.createDataFrame([(0, m, float(m % 4)) for m in range(6)], "k int, month_idx int, value double")
    got = {r.lag: (r.n, r.r) for r in cross_correlation(x, x, ["k"], 8).collect()}
    assert set(got) == set(range(-8, 9)) and got[7] == (0, None) and got[0][0] == 6


def test_absent_months_are_gaps(spark):
    months = [m for m in range(96) if m not in (40, 41)]
    df = spark.createDataFrame([(k, m, float(np.sin(m / 5))) for k in (0, 1) for m in (months if k else range(96))], "g int, month_idx int, value double")
    got = low_pass(df, ["g"], 24).collect()
    assert sum(r.g == 1 for r in got) == 94 and all((r.value is None) == (r.g == 1) for r in got)
    assert {r.g for r in power_spectrum(df, ["g"]).filter("power is not null").collect()} == {0}


def test_an_absent_longitude_is_a_gap(spark):
    rows = [(s, t, x, float(np.sin(t / 3 + x))) for s in (0, 1) for t in range(60) for x in range(12) if (s, x) != (1, 4)]
    df = spark.createDataFrame(rows, "s int, t int, lon_i int, value double")
    got = wave_band(df, ["s"], "kelvin").collect()
    assert all(r.value is None for r in got if r.s == 1) and any(r.value is not None for r in got if r.s == 0)


def test_components_leave_cells_with_gaps_out(spark):
    r = np.random.default_rng(0)
    score, weight = r.normal(size=40), r.normal(size=8)
    rows = [(c, m, float(score[m] * weight[c])) for c in range(8) for m in range(40) if not (c >= 6 and m == 3 + c)]
    df = spark.createDataFrame(rows, "cell int, month_idx int, value double")
    pcs = principal_components(df, [], ["cell"], 1)
    assert pcs.variance.first().share == pytest.approx(1.0)
    assert {x.cell for x in pcs.weights.collect()} == set(range(6))


@pytest.mark.parametrize("offset", [0.0, 1e7, 1e8])
def test_a_large_offset_of_a_predictor_costs_no_digits(spark, offset):
    r = np.random.default_rng(1)
    x, noise = r.normal(size=200), r.normal(size=200)
    y = 2 * x + noise
    field = spark.createDataFrame([(0, m, float(y[m])) for m in range(200)], "cell int, month_idx int, value double")
    p = spark.createDataFrame([(m, float(x[m] + offset)) for m in range(200)], "month_idx int, p double")
    fit = ols(field, p, ["p"], ["cell"]).first()
    slope = np.polyfit(x, y, 1)[0]
    assert fit.coefs[1] == pytest.approx(slope, rel=1e-6)
    assert fit.coefs[0] == pytest.approx(y.mean() - slope * (x.mean() + offset), rel=1e-6)


def test_many_groups_pass_the_merge_in_order(spark):
    df = spark.range(4000).selectExpr("cast(id % 1000 as int) g", "cast(id / 1000 as int) month_idx", "explode(array('a', 'b')) mode").selectExpr("*", "case mode when 'a' then month_idx else -month_idx * g end * 1.0D value")
    got = correlation_table(df.filter("g > 0"), ["month_idx"], ["a", "b"], ["g"]).filter("mode_a = 'a' and mode_b = 'b'").collect()
    assert len(got) == 999 and all(x.r == pytest.approx(-1.0) for x in got)


def test_a_storage_fault_is_not_read_as_nothing_written(spark, tmp_path):
    assert done_keys(spark, str(tmp_path / "none"), ["k"]) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        done_keys(spark, str(tmp_path / "broken"), ["k"])


def test_the_shared_folder_is_empty_after_a_run(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").getOrCreate()
from tidegrid.session import cut_lineage
assert cut_lineage(spark.range(5)).count() == 5
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert not list(tmp_path.glob("tidegrid*"))
