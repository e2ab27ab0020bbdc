import math

from pyspark.sql import functions as F

from tidegrid.schema import missing_to_null, normalize_columns
from tidegrid.session import shared_folder
from tidegrid.sources import readers as R
from tidegrid.sources import writers as W


def test_index_text_file(spark, tmp_path):
    lines = ["  1948 1950", "1948 " + " ".join(str(i + 0.5) for i in range(12)), "1949 -999 " + " ".join(["1.0"] * 11), "1950 " + " ".join(["2"] * 12), "-999", " source text 1 2"]
    path = tmp_path / "index.txt"
    path.write_text("\n".join(lines))
    got = {r.month_idx: r.value for r in R.read_index_text(spark, str(path), n_years=2).collect()}
    assert len(got) == 24 and got[1948 * 12 + 3] == 3.5 and got[1949 * 12] is None and 1950 * 12 not in got


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(math.nan,), (-999.0,), (1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(missing_to_null(F.col("v"))).collect()] == [None, None, 1.0, None]


def test_names_are_normalized(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3, 0)], "latitude double, ULONG double, time_counter int, number int")
    assert normalize_columns(df).columns == ["lat", "lon", "time"]


def test_existing_partitions_are_kept(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    W.write_missing(df.filter("k = 0"), path, ["k"])
    W.write_missing(df.withColumn("v", F.col("v") + 100), path, ["k"])
    got = spark.read.parquet(path)
    assert got.count() == 10 and got.filter("k = 0 and v >= 100").count() == 0
    assert W.pending(df.select("k").distinct(), W.done_keys(spark, path, ["k"]), ["k"]).count() == 0
    W.write_table(df.filter("k = 1"), path, ["k"], overwrite=True)
    assert spark.read.parquet(path).filter("k = 1").agg(F.min("v")).first()[0] == 1 and spark.read.parquet(path).count() == 10


def test_period_tag_from_file_name(spark, tmp_path):
    path = str(tmp_path / "model.190001-199912.parquet")
    spark.range(3).write.parquet(path)
    tagged = R.with_period_tag(spark.read.parquet(path))
    assert tagged.count() == 3 and tagged.select("period").distinct().count() == 1


def test_shared_folder_is_set_once(spark):
    assert shared_folder(spark) == shared_folder(spark)
