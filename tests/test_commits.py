"""Keys are committed whole or not at all, whatever breaks."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.sources import commits as M

KEY = T.StructType([T.StructField("k", T.LongType())])


def _rows(spark, n=12):
    return spark.range(n).select((F.col("id") % 4).alias("k"), F.col("id").alias("v"))


def _read(spark, path):
    return sorted(tuple(r) for r in M.read_done(spark, path, ["k"]).select("k", "v").collect())


def test_a_job_that_fails_commits_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    M.write_keys(_rows(spark).filter("k = 0"), path, ["k"])
    bad = _rows(spark).withColumn("v", F.when(F.col("v") < 9, F.col("v")).otherwise(F.raise_error(F.lit("stop")).cast("long")))
    with pytest.raises(Exception, match="stop"):
        M.write_keys(bad, path, ["k"])
    assert _read(spark, path) == [(0, 0), (0, 4), (0, 8)]
    assert not any((tmp_path / "t" / "_staging").iterdir())


def test_a_key_without_its_mark_is_made_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    marked = []

    def mark(self, key):
        if len(marked) == 2:
            raise OSError("the driver dies between a move and its mark")
        marked.append(key)
        self.fs.create(self.at(key, M.MARK), True).close()

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(M.Folder, "mark", mark)
        M.write_keys(_rows(spark).withColumn("v", F.col("v") + 100), path, ["k"])
    assert sorted(p.name for p in Path(path).glob("k=*")) == ["k=0", "k=1", "k=2"]  # the third is there, but not done
    assert sorted(r.k for r in M.done_keys(spark, path, KEY).collect()) == [0, 1]
    assert {k for k, _ in _read(spark, path)} == {0, 1}
    made = []
    assert M.run_missing(_rows(spark).select("k"), lambda keys: made.extend(keys.collect()) or _rows(spark).join(keys, "k"), path, ["k"], at_once=1) == 2
    assert [r.k for r in made] == [2, 3]
    assert _read(spark, path) == sorted([(i % 4, i + (100 if i % 4 < 2 else 0)) for i in range(12)])
    assert M.run_missing(_rows(spark).select("k"), lambda keys: pytest.fail("nothing is left"), path, ["k"]) == 0


def test_a_killed_process_is_completed(spark, tmp_path):
    path = str(tmp_path / "t")
    code = f"""
import os, sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession, functions as F
from tidegrid.sources import commits as M
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.range(12).select((F.col("id") % 4).alias("k"), (F.col("id") + 100).alias("v"))
calls = []
def make(keys):
    calls.append(1)
    if len(calls) == 2:
        os.kill(os.getpid(), 9)
    return rows.join(keys, "k")
M.run_missing(rows.select("k"), make, {path!r}, ["k"], at_once=2)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=180, env={**os.environ})
    assert done.returncode == -9
    assert M.run_missing(_rows(spark).select("k"), lambda keys: _rows(spark).join(keys, "k"), path, ["k"], at_once=3) == 2
    assert _read(spark, path) == sorted([(i % 4, i + (100 if i % 4 < 2 else 0)) for i in range(12)])


def test_odd_key_values_and_several_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("a b/c", 1, 1.0), ("x=y", None, 2.0), (None, 3, 3.0), ("a b/c", 2, 4.0), ("ü%", 1, 5.0)]
    df = spark.createDataFrame(rows, "name string, part int, v double")
    M.write_keys(df.filter("v < 3"), path, ["name", "part"])
    assert M.missing_keys(df, path, ["name", "part"]).count() == 3
    M.write_keys(M.missing_keys(df.withColumn("v", F.col("v") * 10), path, ["name", "part"]), path, ["name", "part"])
    kind = T.StructType([df.schema["name"], df.schema["part"]])
    assert {tuple(r) for r in M.done_keys(spark, path, kind).collect()} == {r[:2] for r in rows}
    assert sorted(r.v for r in M.read_done(spark, path, ["name", "part"]).collect()) == [1.0, 2.0, 30.0, 40.0, 50.0]


def test_empty_work_and_no_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert M.done_keys(spark, path, KEY) is None
    assert M.run_missing(_rows(spark).filter("false").select("k"), lambda keys: pytest.fail("no key"), path, ["k"]) == 0
    M.write_keys(_rows(spark).filter("false"), path, ["k"])
    assert M.done_keys(spark, path, KEY).count() == 0
    with pytest.raises(ValueError, match="no committed key"):
        M.read_done(spark, path, ["k"])


def test_jobs_grow_with_success_and_shrink_after_a_break(spark, tmp_path):
    path, sizes = str(tmp_path / "t"), []
    rows = spark.range(600).select(F.col("id").alias("k"), F.col("id").alias("v"))

    def make(keys, last=600):
        sizes.append(keys.count())
        return rows.join(keys, "k").withColumn("v", F.when(F.col("k") < last, F.col("v")).otherwise(F.raise_error(F.lit("stop")).cast("long")))

    with pytest.raises(Exception, match="stop"):
        M.run_missing(rows.select("k"), lambda keys: make(keys, 9), path, ["k"], at_once=2)
    assert [k for k, _ in _read(spark, path)] == list(range(8))  # all before the two keys that break
    assert sizes == [2, 4, 8, 2, 4, 2][: len(sizes)] and len(sizes) == 6
    sizes.clear()
    assert M.run_missing(rows.select("k"), make, path, ["k"], at_once=2) == 592
    assert len(sizes) < 10 and _read(spark, path) == [(i, i) for i in range(600)]
