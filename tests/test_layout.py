"""Fields stored by cell are not exchanged again; regressions stand large offsets; month tables don't move the field."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import anomaly as A
from tidegrid.operators.regression import ols, residuals
from tidegrid.plans.queries_layout import chain
from tidegrid.sources.layout import buckets_for, store_by_cell

MONTHS = 120


@pytest.fixture(scope="module")
def cells():
    r = np.random.default_rng(5)
    p = r.normal(size=(MONTHS, 2)) * [3, 50]
    rows = []
    for member in range(3):
        for lat in range(4):
            for lon in range(5):
                y = p @ r.normal(size=2) + r.normal(size=MONTHS) * 5 + np.arange(MONTHS) * 0.1
                rows += [(member, lat, lon, m, 1, float(v) if r.random() > 0.05 else None) for m, v in enumerate(y)]
    return rows, p


def _frames(spark, cells, offset=0.0):
    rows, p = cells
    field = spark.createDataFrame(rows, "member int, lat_i int, lon_i int, month_idx int, n int, value double").withColumn("value", F.col("value") + offset)
    return field, spark.createDataFrame([(m, float(a) + offset, float(b) + offset) for m, (a, b) in enumerate(p)], "month_idx int, p1 double, p2 double")


def _exchanges(df) -> list[str]:
    """Exchanges by hash, range or into one task that field rows go through: those above a group by cell carry one row per cell."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found = []
    for i, line in enumerate(lines):
        if re.search(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", line):
            below = next((x for x in lines[i + 1 :] if re.search("HashAggregate|Window|Scan", x)), "")
            if "HashAggregate(keys=[member" not in below or "partial_" in below:
                found.append(line)
    return found


def test_a_chain_on_a_stored_field_exchanges_nothing(spark, cells):
    field, p = _frames(spark, cells)
    layout = store_by_cell(field, A.CELL, buckets=6)
    done = chain(layout, p, ["p1", "p2"])
    assert _exchanges(done) == []
    # the same chain without the layout has exchanges and the same values
    plain = chain(field, p, ["p1", "p2"])
    assert _exchanges(plain)
    assert sorted(map(tuple, done.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    # one bucket, one task
    assert done.rdd.getNumPartitions() == 6


def test_a_table_derived_from_a_stored_one_is_written_bucket_by_bucket(spark, cells):
    field, _ = _frames(spark, cells)
    first = store_by_cell(field, A.CELL, buckets=4)
    # small files would be read together by one task
    openings = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        second = store_by_cell(first.withColumn("value", F.col("value") * 2), A.CELL, buckets=4)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", openings[0])
        spark.conf.unset("spark.sql.files.minPartitionNum") if openings[1] is None else spark.conf.set("spark.sql.files.minPartitionNum", openings[1])
    tasks = [re.search(r"/part-(\d+)-", f)[1] for f in second.inputFiles()]
    assert len(tasks) == len(set(tasks)) == 4
    assert second.count() == field.count()
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"
    assert buckets_for(spark, 0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert buckets_for(spark, 10**9 + 1) == 1001


def test_layout_of_an_empty_table(spark, cells):
    field, p = _frames(spark, cells)
    layout = store_by_cell(field.filter("false"), A.CELL, buckets=3)
    assert chain(layout, p, ["p1", "p2"]).count() == 0 and layout.columns == field.columns


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_regression_with_an_offset_is_that_of_numpy(spark, cells, offset):
    rows, p = cells
    field, months = _frames(spark, cells, offset)
    got = {(r.member, r.lat_i, r.lon_i): r for r in ols(field, months, ["p1", "p2"], A.CELL, drop_missing=True).collect()}
    for key, r in got.items():
        y = np.array([v if v is not None else np.nan for *k, _, _, v in rows if tuple(k) == key])
        ok = np.isfinite(y)
        x = np.column_stack([np.ones(ok.sum()), p[ok]])
        b, sse, *_ = np.linalg.lstsq(x, y[ok], rcond=None)
        assert r.n == ok.sum()
        assert np.allclose(r.coefs[1:], b[1:], atol=1e-6)
        assert abs(r.r2 - (1 - sse[0] / ((y[ok] - y[ok].mean()) ** 2).sum())) < 1e-6
    flat = ols(_frames(spark, cells)[0], _frames(spark, cells)[1], ["p1", "p2"], A.CELL, drop_missing=True).collect()
    for r in flat:
        assert np.allclose(r.p_values[1:], got[(r.member, r.lat_i, r.lon_i)].p_values[1:], atol=1e-6)


def test_a_missing_predictor_is_a_missing_month(spark, cells):
    field, p = _frames(spark, cells)
    some = p.withColumn("p2", F.when(F.col("month_idx") >= 10, F.col("p2")))
    a = ols(field, some, ["p1", "p2"], A.CELL, drop_missing=True).orderBy(*A.CELL).collect()
    b = ols(field.filter("month_idx >= 10"), p, ["p1", "p2"], A.CELL, drop_missing=True).orderBy(*A.CELL).collect()
    assert [r.n for r in a] == [r.n for r in b]
    assert np.allclose([r.coefs for r in a], [r.coefs for r in b])


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_trend_of_a_cell_far_from_zero(spark, offset):
    rows = [(0, m, offset + 3.0 + 0.5 * m - 0.01 * m * m) for m in range(60)]
    got = A.detrend_cells(spark.createDataFrame(rows, "cell int, month_idx int, value double"), ["cell"], 2).collect()
    assert max(abs(r.value) for r in got) < 1e-6 and abs(got[0].slope - 0.5) < 1e-4
    assert max(abs(r.fit - v) for r, (_, _, v) in zip(sorted(got, key=lambda r: r.month_idx), rows)) < 1e-6


def test_months_from_a_large_plan_do_not_move_the_field(spark, cells):
    """The month table seems as large as the field it comes from until it is stored."""
    field, p = _frames(spark, cells)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    path_field = store_by_cell(field, A.CELL, buckets=4)
    size = path_field._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(min(int(size) - 1, 20_000)))
    try:
        mean = path_field.groupBy("month_idx").agg(F.avg("value").alias("mean"))
        out = A.subtract_monthly(path_field, mean, "mean")
        initial = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in initial and "hashpartitioning(month_idx" not in initial
        fit = ols(path_field, p, ["p1"], A.CELL, drop_missing=True)
        assert _exchanges(residuals(path_field, p, fit, ["p1"], A.CELL)) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
