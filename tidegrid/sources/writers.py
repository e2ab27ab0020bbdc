"""Writers: partitioned Parquet, skip-if-done and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.sources import commits


def write_table(df: DataFrame, path: str, by: list[str], overwrite: bool = False) -> None:
    """Partitioned Parquet, committed key by key; without ``overwrite`` a table with a committed key stays as it is.

    The rebalance hint gathers small outputs and lets adaptive execution split a partition
    value that holds much of the table, so no single task writes it alone.
    """
    if not by:
        df.hint("rebalance").write.mode("overwrite" if overwrite else "ignore").parquet(path)
    elif overwrite or not commits.Folder(df.sparkSession, path).keys(by, leaf=commits.MARK):
        commits.write_keys(df, path, by)


def done_keys(spark: SparkSession, path: str, keys: list[str], schema: T.StructType | None = None) -> DataFrame | None:
    """Keys already committed, as text or with the types of ``schema``; None where nothing is there yet."""
    kinds = [schema[k] if schema else T.StructField(k, T.StringType()) for k in keys]
    return commits.done_keys(spark, path, T.StructType(kinds))


def pending(work: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Work list without the finished keys."""
    return work if done is None else work.join(done.select(*keys).distinct(), keys, "left_anti")


def write_missing(df: DataFrame, path: str, by: list[str]) -> None:
    """Add only the keys that are not committed; what is done stays as it is."""
    commits.write_keys(commits.missing_keys(df, path, by), path, by)
