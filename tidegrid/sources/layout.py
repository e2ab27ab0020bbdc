"""Fields stored by cell, so that one exchange serves a whole chain of operators.

A table written by :func:`store_by_cell` is bucketed: all rows of a cell are in one file, hashed as Spark hashes an exchange. Windows and
groups over the cell, or over the cell and the calendar month, and joins with per-cell results then need no exchange of the
field. Small sides (months, predictors) are stored tables of a known size.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidegrid.session import run_folder

#: Rows of a bucket on average, of tables whose size is known.
BUCKET_ROWS = 1_000_000


def store_by_cell(df: DataFrame, keys: list[str], t: str = "month_idx", buckets: int | None = None) -> DataFrame:
    """Write ``df`` bucketed by ``keys``, sorted by time within a cell, and read it back.

    One task writes one bucket, so ``buckets`` (by default the number of shuffle partitions) decides the size of a task in all that
    follows: choose it so that a bucket fits in a task, a few hundred megabytes each. Tables that are joined with each other by
    cell need the same number. The table lives in the run folder and ends with the application.

    A table that is derived row by row from one stored alike is written without an exchange. Spark would then read the first by file size, though, and
    a task would sort and write rows of several buckets; so the tasks are held to the buckets.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidegrid_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*dict.fromkeys([*keys, t]))
    held = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(held)
    spark.conf.set(held, "false")
    try:
        dealt.option("path", f"{run_folder(spark)}/{name}").saveAsTable(name)
    finally:
        spark.conf.set(held, before)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def buckets_for(spark: SparkSession, rows: int) -> int:
    """As many buckets as there are shuffle partitions, more if ``rows`` need them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def _drop(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Py4JError, OSError, PySparkException, AttributeError):  # the session may be gone, and the catalog with it
        spark.sql(f"drop table if exists {name}")
