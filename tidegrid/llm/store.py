"""Tables in the shared folder that cut a plan, and small helpers for kernels over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import run_folder

#: Bytes of text that a kernel turns into numpy arrays at once; batching only, results do not depend on it.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to a new table of the shared folder and read it back; also its path."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, kernels get at most so many rows at once: rows that hold whole sets or bitmaps fill memory otherwise. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return memory that is free to the system. A worker lives through many stages, and would hold the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)


def frugal(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel`` that gives back what it has freed when its task ends. Results do not depend on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def release(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def split_join(rows: DataFrame, summed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with an aggregate on its own keys so that a hot key can be split.

    Joined directly, the aggregate keeps its partitioning and adaptive execution cannot divide the other side. The first key, an
    integer, is complemented on both sides, so that each side has an exchange of its own.
    """
    key = on[0]
    flip = F.bitwise_not(F.col(key))
    left, right = rows.withColumn("__flip", flip), summed.withColumn("__flip", flip).drop(key)
    return left.join(right, ["__flip", *on[1:]], how).drop("__flip")


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of whole texts that hold about ``limit`` bytes."""
    at = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield at, i
            at, size = i, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def list_column(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists of ``counts[i]`` consecutive values of ``flat``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, type=kind))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_text_column(docs: DataFrame, text: str, name: str, kind: T.DataType, make: Callable[[], Callable[[list[bytes]], list | np.ndarray]]) -> DataFrame:
    """``docs`` with one more column computed from the whole texts, without a shuffle; ``make()`` runs once per task."""
    if name in docs.columns:
        raise ValueError(f"column {name} is there already")
    at = docs.columns.index(text)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            values = of(byte_texts(b.column(at))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, kinds[kind.typeName()])], [*b.schema.names, name])

    kinds = {"double": pa.float64(), "binary": pa.binary(), "long": pa.int64()}
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))
