"""Blocks of long series next to whole windows, whole transforms and whole sorts."""

import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.functions.quantiles import counted_quantiles, sorted_quantiles
from tidegrid.operators import long_series as B
from tidegrid.operators import series as Q
from tidegrid.operators.spectrum import power_spectrum

KEYS = ["g", "h"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two series with absent steps and NULLs, one hot; negative steps; a key that is NULL; a value row repeated in another series."""
    r = np.random.default_rng(2)
    out = [(g, h, int(x), float(r.normal()) if r.random() > 0.15 else None) for g, h, n in ((1, "a", 700), (1, None, 90), (2, "a", 1)) for x in r.permutation(np.arange(-50, n)) if r.random() > 0.05]
    return spark.createDataFrame(out, "g int, h string, x int, value double").withColumn("extra", F.lit("e"))


def _sorted(df, *cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*KEYS, "x", *cols, "extra").collect()), key=repr)


@pytest.mark.parametrize("size", [1, 5, 64, 10_000])
def test_windows_in_blocks(spark, rows, size):
    for width in (1, 2, 3, 24):
        assert _sorted(B.centred_mean_blocks(rows, KEYS, width, "x", size=size), "value") == _sorted(Q.centred_mean(rows, KEYS, width, "x"), "value")
        assert _sorted(B.trailing_sum_blocks(rows, KEYS, width, "x", size=size), "value") == _sorted(Q.trailing_sum(rows, KEYS, width, "x"), "value")
    w = Window.partitionBy(*KEYS).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    assert _sorted(B.cumulative_sum_blocks(rows, KEYS, "x", size=size), "cumulative") == _sorted(rows.withColumn("cumulative", F.sum("value").over(w)), "cumulative")
    assert _sorted(B.fill_gaps_blocks(rows, KEYS, "x", size=size), "value") == _sorted(Q.fill_gaps(rows, KEYS, "x"), "value")


def test_a_hot_series_is_spread_and_no_window_has_the_key_alone(spark):
    df = spark.range(40_000).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("x"), F.rand(1).alias("value"))
    for out in (B.trailing_sum_blocks(df, ["g"], 5, "x", size=1000), B.fill_gaps_blocks(df, ["g"], "x", size=1000), B.cumulative_sum_blocks(df, ["g"], "x", size=1000)):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            sizes = [r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sum(sizes) == 40_000 and max(sizes) < 25_000
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        rows_below = [x for x in re.findall(r"Window \[.*?\], \[(.*?)\]", plan) if "_block" not in x]
        assert len(rows_below) <= 1  # over the blocks' sums


def test_empty_tables(spark, rows):
    none = rows.filter("false")
    assert B.centred_mean_blocks(none, KEYS, 3, "x").count() == B.fill_gaps_blocks(none, KEYS, "x").count() == B.cumulative_sum_blocks(none, KEYS, "x").count() == 0
    assert B.power_spectrum_blocks(none, KEYS, 12, "x").count() == 0
    assert counted_quantiles(none, KEYS, "value", [0.5]).count() == 0


@pytest.mark.parametrize("length, block", [(1, 4), (2, 4), (60, 1), (60, 4), (60, 7), (60, 1000), (61, 4), (127, 8), (121, 3)])
def test_transform_of_any_length_and_block(spark, length, block):
    r = np.random.default_rng(length)
    z = r.normal(size=(3, length)) + 1j * r.normal(size=(3, length))
    df = spark.createDataFrame([(g, n, float(z[g, n].real), float(z[g, n].imag)) for g in range(3) for n in range(length)], "g int, n long, re double, im double")
    got = np.zeros((3, length), complex)
    found = B.long_transform(df, ["g"], length, block).collect()
    for row in found:
        got[row.g, row.n] = row.re + 1j * row.im
    assert len(found) == 3 * length and np.allclose(got, np.fft.fft(z, axis=1), atol=1e-9 * length)


@pytest.mark.parametrize("length", [96, 97])
def test_spectrum_in_blocks_is_the_spectrum(spark, length):
    r = np.random.default_rng(4)
    rows = [(g, t + 1000, float(r.normal()) if (g, t) != (2, 7) else None) for g in range(4) for t in range(length) if (g, t) != (3, 5)]
    df = spark.createDataFrame(rows, "g int, t int, value double")
    want = {(r.g, r.k): (r.freq, r.power) for r in power_spectrum(df.filter("g < 2"), ["g"], "t").collect()}
    for block in (4, 1000):
        got = {(r.g, r.k): (r.freq, r.power) for r in B.power_spectrum_blocks(df, ["g"], length, block=block).collect()}
        assert {k for k in got if k[0] < 2} == set(want)
        assert all(got[k] == pytest.approx(v, abs=1e-10) for k, v in want.items())
        assert [v[1] for k, v in got.items() if k[0] >= 2] == [None] * (2 * (length // 2 + 1))


def test_counted_quantiles(spark):
    r = np.random.default_rng(6)
    values = {"a": r.normal(size=3000) * 10.0 ** r.integers(-300, 300, 3000), "b": np.array([1.0]), "c": np.repeat([0.0, -0.0, 5.0, -5e-324], 7), None: r.integers(0, 3, 500) * 1.0}
    data = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("d", None)]
    df = spark.createDataFrame(data, "g string, value double")
    probs = [0.0, 0.1, 0.5, 0.975, 1.0]
    got = {(r.g, r.prob): r.quantile for r in counted_quantiles(df, ["g"], "value", probs).collect()}
    assert len(got) == 4 * 5
    for k, vs in values.items():
        s, n = np.sort(vs), len(vs)
        for p in probs:
            h = (n - 1) * p
            f = h - np.floor(h)
            assert got[(k, p)] == pytest.approx(s[int(np.floor(h))] * (1 - f) + s[int(np.ceil(h))] * f, rel=1e-12, abs=0)
    whole = df.filter("value is not null and not isnan(value)")
    assert [tuple(r) for r in counted_quantiles(whole, [], "value", [0.3]).collect()] == [tuple(r) for r in sorted_quantiles(whole, [], "value", [0.3]).collect()]


def _shuffled(spark):
    """Bytes that all tasks so far have written for exchanges."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_counts_are_all_that_quantiles_exchange(spark):
    """What is exchanged is bounded by the buckets and partitions, so it doesn't follow the rows of the table."""

    def written(n):
        before = _shuffled(spark)
        df = spark.range(n).select(F.lit(1).alias("g"), (F.xxhash64("id") / 1e10).alias("value"))
        counted_quantiles(df, ["g"], "value", [0.5]).collect()
        return _shuffled(spark) - before

    small, large = written(200_000), written(2_000_000)
    assert 0 < large < 2 * small
