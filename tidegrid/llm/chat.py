"""Chat formatting: logged snapshots of growing conversations are collapsed to the longest ones, which are then rendered.

A conversation that was logged after every turn is there many times, each time a prefix of the next. Every turn gets the hash of all
turns up to it; a conversation whose last hash is an inner hash of another one is a prefix of it and falls to an anti-join.
Everything is DataFrame work; a long conversation is cut into pieces of ``PIECE`` turns, so that no task needs all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.store import split_join, store

PIECE = 1024  # turns


def _running(rows: DataFrame, kinds: dict[str, str], values: dict[str, str]) -> DataFrame:
    """``rows`` (conv, at, ...) with running aggregates over all turns up to ``at``, equal ones included.

    ``values`` names the new columns and what they aggregate, ``kinds`` how: ``sum`` or ``bit_xor``. Pieces are summed up first, then their
    totals along the conversation, then the turns inside each piece.
    """
    piece = F.expr(f"at div {PIECE}")
    cut = rows.withColumn("piece", piece)
    agg = {"sum": F.sum, "bit_xor": F.bit_xor}
    totals = cut.groupBy("conv", "piece").agg(*(agg[kinds[n]](v).alias(n) for n, v in values.items()))
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv", "piece", *(F.coalesce(agg[kinds[n]](n).over(earlier), F.lit(0)).alias(f"__{n}") for n in values))
    inner = Window.partitionBy("conv", "piece").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def joined(n: str) -> Column:
        now, past = F.col(n), F.col(f"__{n}")
        return (now + past if kinds[n] == "sum" else now.bitwiseXOR(past)).alias(n)

    own = cut.select("*", *(agg[kinds[n]](v).over(inner).alias(n) for n, v in values.items()))
    full = own.join(before, ["conv", "piece"])
    return full.select(*rows.columns, *(joined(n) for n in values))


def maximal_turns(turns: DataFrame) -> DataFrame:
    """(conv, at, turn, role, text): turns of the conversations that are no prefix of another one.

    Of equal conversations the one with the smallest id stays. Rows without conversation or turn belong to none; null roles and texts count as
    empty; repeated rows count once; different rows of one turn are both part of it. Turns count from the first of the conversation.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).filter("conv is not null and turn is not null")
    rows = rows.distinct()
    first = rows.groupBy("conv").agg(F.min("turn").alias("__first"))
    rows = split_join(rows, first, ["conv"]).withColumn("at", F.col("turn") - F.col("__first")).drop("__first")
    rows, _ = store(rows.select("conv", "at", "turn", "role", "text"), "turns")
    hashed = rows.select("conv", "at", F.xxhash64("at", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role", "at").alias("b"), F.lit(1).cast("long").alias("one"))
    kinds = {"ha": "bit_xor", "hb": "bit_xor", "n": "sum"}
    prefixes, _ = store(_running(hashed, kinds, {"ha": "a", "hb": "b", "n": "one"}).select("conv", "at", "ha", "hb", "n").distinct(), "prefixes")
    ends = prefixes.groupBy("conv").agg(F.max_by(F.struct("at", "ha", "hb", "n"), "at").alias("e")).select("conv", "e.*")
    key = ["at", "ha", "hb", "n"]
    inner = split_join(prefixes, ends.select("conv", F.col("at").alias("__last")), ["conv"]).filter("at < __last").select(*key).distinct()
    kept = ends.groupBy(*key).agg(F.min("conv").alias("conv")).join(inner, key, "left_anti").select("conv")
    kept, _ = store(kept, "kept")
    return rows.join(kept, "conv", "left_semi")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, segment, start, trainable) of every turn of :func:`maximal_turns`.

    The segments of a conversation, joined in order, are its text; ``start`` is the first character of the segment in it. Rows of one turn follow
    by role and text. Only the assistant's turns are trained on.
    """
    segment = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    rows = turns.withColumn("segment", segment).withColumn("size", F.char_length("segment").cast("long"))
    ran = _running(rows, {"until": "sum"}, {"until": "size"})
    # rows of one turn share the running sum: take off what follows in the turn
    later = Window.partitionBy("conv", "at").orderBy(F.desc("role"), F.desc("text")).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("until") - F.sum("size").over(later)
    return ran.select(F.col("conv").alias("conv_id"), "turn", "role", "segment", start.alias("start"), (F.col("role") == "assistant").alias("trainable"))
