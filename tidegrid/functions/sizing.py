"""Small sides of joins.

No side is forced to be broadcast because of its number of rows. Rows that the program spells out are
(:func:`constant_side`). A model table is stored first (:func:`checked_side`), so Spark knows its bytes and decides by
``spark.sql.autoBroadcastJoinThreshold``. Tables with one row per month (:func:`calendar_side`) are stored too: estimated from a large
plan they would seem large, and the field would be exchanged on a few hundred months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage


def calendar_side(df: DataFrame) -> DataFrame:
    """Side with one row per ``month_idx``, stored; a month that is there twice is an error."""
    many = F.count(F.lit(1)).over(Window.partitionBy("month_idx"))
    repeated = F.raise_error(F.concat(F.lit("month_idx is repeated: "), F.col("month_idx").cast("string")))
    return checked_side(df.withColumn("_many", many).withColumn("month_idx", F.when(F.col("_many") == 1, F.col("month_idx")).otherwise(repeated.cast("int"))).drop("_many"))


def constant_side(df: DataFrame) -> DataFrame:
    """Side whose rows are literals of the program (labels, kernel weights, rule tables)."""
    return F.broadcast(df)


def checked_side(df: DataFrame) -> DataFrame:
    """Store a model table once; its size in bytes then decides how it is joined."""
    return cut_lineage(df)
