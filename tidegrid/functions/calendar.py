"""Month arithmetic: the time key is ``month_idx = year * 12 + month - 1``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Months of the years 0..9999: the domain of ``month_idx`` and so the row bound of any
# table that has one row per month.
CALENDAR_MONTHS = 120_000


def month_index(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def month_of(month_idx: Column) -> Column:
    return (F.pmod(month_idx, F.lit(12)) + 1).cast("int")


def year_of(month_idx: Column) -> Column:
    return F.floor(month_idx / 12).cast("int")


def month_start(month_idx: Column) -> Column:
    return F.make_date(year_of(month_idx), month_of(month_idx), F.lit(1))


def parse_yyyymmdd(value: Column) -> Column:
    """Integer dates such as 20150301."""
    return F.to_date(value.cast("string"), "yyyyMMdd")


def rebuild_date(year: Column, month: Column, day: Column, century: int | None = None) -> Column:
    """Date of a non-standard calendar from its parts; ``century`` folds the year into 100 years. A day that the year lacks is NULL."""
    y = year if century is None else F.lit(century) + F.pmod(year, F.lit(100))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day), "yyyy-MM-dd")


def month_spine(spark: SparkSession, first: str, last: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Every month start from ``first`` to ``last`` inclusive, without the dates in ``skip``."""
    spine = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("date")
    )
    if skip:
        spine = spine.filter(~F.col("date").isin([F.to_date(F.lit(d)) for d in skip]))
    return spine.withColumn("month_idx", month_index(F.col("date")))


def stream_tag(year: Column) -> Column:
    """Archive stream of a year: operational from 2015, consolidated before."""
    return F.when(year >= 2015, F.lit("OPER")).otherwise(F.lit("CONS"))
