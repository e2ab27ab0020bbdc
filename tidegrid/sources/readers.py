"""Readers: gridded tables, experiment outputs and climate-index text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.calendar import stream_tag
from tidegrid.schema import missing_to_null, normalize_columns

# Column names of an index text file after the year (fixed values).
MONTH_COLUMNS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def read_field(spark: SparkSession, path: str | list[str], variable: str | None = None, dataset: str | None = None) -> DataFrame:
    """One variable of a field table; many files, globs and partition directories read as one."""
    df = normalize_columns(spark.read.parquet(*([path] if isinstance(path, str) else path)))
    if variable is not None:
        df = df.filter(F.col("variable") == variable)
    if dataset is not None:
        df = df.filter(F.col("dataset") == dataset)
    return df.withColumn("value", missing_to_null(F.col("value")))


def read_encodings(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Experiment outputs laid out as ``initialization=/split=/recursion=`` partitions."""
    df = spark.read.parquet(path)
    return df if kind is None else df.filter(F.col("kind") == kind)


def read_series(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if series_id is None else df.filter(F.col("series_id") == series_id)


def with_period_tag(df: DataFrame) -> DataFrame:
    """Period tag of the file a row came from: the part of the name before the suffix."""
    return df.withColumn("period", F.element_at(F.split(F.col("_metadata.file_name"), "\\."), -2))


def with_stream(df: DataFrame, year: Column) -> DataFrame:
    """Archive stream and file stem of each month (``..._YYYYMM_STREAM``)."""
    return df.withColumn("stream", stream_tag(year))


def manifest_name(prefix: str, year: Column, month: Column) -> Column:
    return F.concat(F.lit(prefix), F.format_string("%04d%02d_", year, month), stream_tag(year))


def parse_index_lines(lines: DataFrame, n_years: int | None = None, sentinel: float = -999.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines ``YEAR v1 .. v12`` to one row per month; other lines are headers or footers.

    A year that is not over has fewer values: its further months are missing.

    ``n_years`` keeps the first years of each file, where a source appends other text.
    """
    parts = F.split(F.trim("value"), "\\s+")
    year = "^[0-9]{4}$"
    rows = lines.select(*by, parts.alias("p")).filter(F.size("p").between(2, 13) & F.col("p")[0].rlike(year))
    rows = rows.filter(~((F.size("p") == 2) & F.col("p")[1].rlike(year)))  # first and last year of the file
    rows = rows.withColumn("year", F.col("p")[0].cast("int"))
    if n_years is not None:
        # at most one row per calendar year and file
        rank = F.row_number().over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("year"))
        rows = rows.withColumn("_k", rank).filter(F.col("_k") <= n_years).drop("_k")
    wide = rows.select(*by, "year", *[F.try_element_at("p", F.lit(i + 2)).try_cast("double").alias(m) for i, m in enumerate(MONTH_COLUMNS)])
    long = wide.unpivot([*by, "year"], list(MONTH_COLUMNS), "month_name", "value")
    month0 = F.array_position(F.lit(list(MONTH_COLUMNS)), F.col("month_name")) - 1
    return long.select(
        *by, (F.col("year") * 12 + month0).cast("int").alias("month_idx"), missing_to_null(F.col("value"), sentinel).alias("value")
    )


def read_index_text(spark: SparkSession, path: str, n_years: int | None = None, sentinel: float = -999.0) -> DataFrame:
    return parse_index_lines(spark.read.text(path), n_years, sentinel)


def stack_sources(parts: dict[str, DataFrame], label: str = "dataset") -> DataFrame:
    """Several series or fields as one table with a label column."""
    return reduce(DataFrame.unionByName, [df.withColumn(label, F.lit(name)) for name, df in parts.items()])
