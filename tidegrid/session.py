"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "tidegrid") -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit command decides
    them, and adaptive execution coalesces small shuffles and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session that runs in one process (tests, laptops) makes a temporary one where none is named;
    on a cluster that is an error, since every machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if current is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tidegrid-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
        current = spark.sparkContext.getCheckpointDir()
    return current


def run_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared one, deleted when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tidegrid-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if path not in _made:
        fs.mkdirs(where)
        _made.add(path)
        atexit.register(_drop, fs, where)
    return path


def _drop(fs, where) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone
        fs.delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back: it survives the loss of executors.

    Readers get its size and only the columns they need.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
