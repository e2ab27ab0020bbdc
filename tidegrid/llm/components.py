"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.store import release, split_join, store


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) rows with the least of u and its v; the minimum is summed up before it is shuffled."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return split_join(pairs, least, ["u"]).withColumn("m", F.least("m", "u"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = _with_least(down)
    own = near.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(own).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """``edges`` (a, b long): one row (node, root) per node that has a link and isn't the least of its component.

    Every round is stored in the shared folder and the one before it is dropped; the number of rounds is
    logarithmic in the size of the largest component.
    """
    spark = edges.sparkSession
    now, path = store(edges.select("a", "b").filter("a <> b").distinct(), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        nxt, new = store(_small(_large(now)), "links")
        release(spark, path)
        now, path, before, state = nxt, new, state, _state(nxt)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")), path
