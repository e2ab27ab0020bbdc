"""Commit of partitioned tables key by key.

Rows of a job go to a staging folder first. When the job has ended, the folder of each key is moved to its place and marked with an
empty file; only a marked key counts as done. A job that fails leaves nothing but staging, and one that dies between two
moves leaves whole keys and at most one for each mover that lacks its mark, which the next job replaces. Names of staging and marks
begin with an underscore, so readers pass over them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "_DONE"
STAGING = "_staging"

# how Spark names the folder of a missing key value (fixed value)
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"

#: Threads that move keys, and the keys that one moves in a row.
MOVERS, IN_A_ROW = 16, 64

#: Keys of a job at most.
MOST_AT_ONCE = 4096


class Folder:
    """A folder of a file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        self._paths = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths
        self.root = path.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.at(*parts))

    def keys(self, by: list[str], under: str = "", leaf: str = "") -> list[str]:
        """Folders ``k1=../k2=..`` below the root (or ``under``); with ``leaf`` only those that have such a file."""
        pattern = "/".join([p for p in (under, *[f"{k}=*" for k in by], leaf) if p])
        start = self.fs.makeQualified(self.at(under) if under else self.at()).toString()
        found = self.fs.globStatus(self.at(pattern))
        names = [f.toString()[len(start) :].strip("/") for f in self._paths(found)] if found else []
        return sorted(n.rsplit("/", 1)[0] if leaf else n for n in names)

    def values(self, key: str) -> list[str | None]:
        """Values of a key folder, as text."""
        texts = [part.split("=", 1)[1] for part in key.split("/")]
        return [None if x == NULL_FOLDER else self._unescape(x) for x in texts]

    def mark(self, key: str) -> None:
        self.fs.create(self.at(key, MARK), True).close()

    def place(self, staged: str, key: str, there: bool) -> None:
        """Move a staged key to its place, below a folder that exists; what is there without a mark, or is replaced, goes."""
        if there:
            self.fs.delete(self.at(key, MARK), False)  # from here on the key is not done
            self.fs.delete(self.at(key), True)
        if not self.fs.rename(self.at(staged, key), self.at(key)):
            raise OSError(f"{key} could not be moved into place")
        self.mark(key)


def write_keys(df: DataFrame, path: str, by: list[str]) -> None:
    """Write the keys of ``df``, each whole or not at all; keys that are there are replaced, others stay.

    The rebalance hint gathers small outputs and lets adaptive execution split a key that holds much of the table.
    """
    folder, staged = Folder(df.sparkSession, path), f"{STAGING}/{uuid.uuid4().hex}"
    try:
        # tasks move their own files into staging; a job that fails leaves some there, which go with it
        rows = df.hint("rebalance", *[F.col(c) for c in by]).write.partitionBy(*by).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        rows.parquet(folder.at(staged).toString())
        keys, there = folder.keys(by, staged), set(folder.keys(by))
        for parent in {k.rpartition("/")[0] for k in keys}:
            folder.fs.mkdirs(folder.at(parent) if parent else folder.at())

        def move(some: list[str]) -> None:
            for key in some:
                folder.place(staged, key, key in there)

        with ThreadPoolExecutor(MOVERS) as movers:
            list(movers.map(move, [keys[i : i + IN_A_ROW] for i in range(0, len(keys), IN_A_ROW)]))
    finally:
        folder.fs.delete(folder.at(staged), True)


def done_keys(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Committed keys with the types of ``schema``; None where nothing is there yet. Files that belong to no key are an error."""
    folder = Folder(spark, path)
    if not folder.exists():
        return None
    stray = [f.getPath().getName() for f in folder.fs.listStatus(folder.at()) if f.isFile() and f.getPath().getName()[0] not in "_."]
    if stray:
        raise ValueError(f"{path} holds files of no key: {stray[:3]}")
    names = schema.fieldNames()
    rows = [folder.values(k) for k in folder.keys(names, leaf=MARK)]
    text = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return text.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_done(spark: SparkSession, path: str, by: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Rows of the committed keys only; with a ``schema``, none is an empty table instead of an error."""
    folder = Folder(spark, path)
    keys = folder.keys(by, leaf=MARK)
    if not keys and schema is not None:
        return spark.createDataFrame([], schema)
    if not keys:
        raise ValueError(f"{path} has no committed key")
    return spark.read.option("basePath", folder.root).parquet(*[folder.at(k).toString() for k in keys])


def missing_keys(work: DataFrame, path: str, by: list[str]) -> DataFrame:
    """The work list without the committed keys; missing key values are keys too."""
    keys = T.StructType([work.schema[k] for k in by])
    done = done_keys(work.sparkSession, path, keys)
    if done is None:
        return work
    done = done.withColumnsRenamed({k: f"_{k}" for k in by})
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return work.join(done, same, "left_anti")


def run_missing(work: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, by: list[str], at_once: int = 1) -> int:
    """Compute and commit the keys of ``work`` that are not done, at first ``at_once`` of them a job; returns how many.

    ``make`` gets the keys of a job and returns their rows. Each job that succeeds doubles the keys of the next, up to `MOST_AT_ONCE`, so jobs
    don't grow in number with the keys; one that breaks is made again from ``at_once`` keys on. So what precedes the ``at_once`` keys that
    break a run is committed, survives, and is not computed again. The keys of a work list are a table of its own that is listed here; rows never are.
    """
    todo = missing_keys(work.select(*by).distinct(), path, by).orderBy(*by).collect()
    spark, kind = work.sparkSession, T.StructType([work.schema[k] for k in by])
    done, size = 0, at_once
    while done < len(todo):
        some = todo[done : done + size]
        try:
            write_keys(make(spark.createDataFrame(some, kind)), path, by)
        except (PySparkException, Py4JJavaError):
            if len(some) <= at_once:
                raise
            size = at_once
        else:
            done, size = done + len(some), max(at_once, min(2 * size, MOST_AT_ONCE))
    return len(todo)
