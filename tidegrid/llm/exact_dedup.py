"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. Equal blocks get the same integer, different ones different
integers, by sorting the distinct blocks. Then adjacent integers are paired, and the distinct pairs are sorted and named in the same way, until
each text has one integer. No hash decides: texts are equal when their number of blocks and their last name are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidegrid.llm.store import byte_texts, free_name, frugal, release, split_join, store, with_text_column

BLOCK = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _sha(texts: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(t.translate(_LOWER)).digest() for t in texts]


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """(id, sha, blocks, pos, content) of each block; an empty text has one empty block."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for key, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                low = text.translate(_LOWER)
                sha, many = hashlib.sha256(low).digest(), max(1, -(-len(low) // block))
                for pos in range(many):
                    for col, value in zip(out, (key, sha, many, pos, low[pos * block : (pos + 1) * block])):
                        col.append(value)
                held += len(low)
                if held > 8_000_000:
                    yield _batch(out)
                    out, held = ([], [], [], [], []), 0
            yield _batch(out)

    return docs.mapInArrow(run, "id long, sha binary, blocks int, pos int, content binary")


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["id", "sha", "blocks", "pos", "content"])


def _names(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values of ``by``, sorted and named: number of the partition and place in it."""
    return rows.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(raw: DataFrame, handle: Column) -> tuple[DataFrame, list[str]]:
    """(id, sha, blocks, pos, name) of each block.

    Contents are shuffled once, after equal ones have been merged where they are read. The names come back to the blocks
    by a 64-bit handle; contents that share a handle with another content are joined by content instead.
    """
    names, path = store(_names(raw, ["content"]).select(handle.alias("h"), "name"), "block-names")
    clash = names.groupBy("h").count().filter("count > 1").select("h")
    refs = raw.select("id", "sha", "blocks", "pos", handle.alias("h"))
    if clash.isEmpty():
        return refs.join(names, "h").drop("h"), [path]
    theirs, clash_path = store(_names(raw.withColumn("h", handle).join(clash, "h"), ["content"]), "clashes")
    apart = raw.join(theirs, "content").select("id", "sha", "blocks", "pos", (-F.col("name") - 1).alias("name"))
    return refs.join(clash, "h", "left_anti").join(names, "h").drop("h").union(apart), [path, clash_path]


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, handle: Column | None = None) -> DataFrame:
    """(id, sha, blocks, name, copies): one row per key and text, with the number of equal rows; (blocks, name) is the identity.

    Null texts count as empty. The result is stored. ``handle`` replaces the 64-bit hash of ``content`` that brings names back.
    """
    spark = docs.sparkSession
    raw = _blocks(docs.select(F.col(key).cast("long").alias("id"), text), block)
    first, paths = _named_blocks(raw, F.xxhash64("content") if handle is None else handle)
    now, path = store(first.groupBy("id", "sha", "blocks", "pos", "name").agg(F.count(F.lit(1)).alias("copies")), "named")
    paths.append(path)
    done = [now.filter("blocks = 1")]
    level, longest = 1, now.agg(F.max("blocks")).first()[0] or 1
    while level < longest:
        left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        half = now.filter(f"blocks > {level}").groupBy("id", "sha", "blocks", F.expr("pos div 2").cast("int").alias("p"))
        pairs, pairs_path = store(half.agg(left.alias("x"), right.alias("y"), F.max("copies").alias("copies")), "pairs")
        names, names_path = store(_names(pairs, ["x", "y"]), "pair-names")
        named = pairs.join(names, (pairs.x == names.x) & pairs.y.eqNullSafe(names.y))
        now, path = store(named.select("id", "sha", "blocks", F.col("p").alias("pos"), "name", "copies"), "named")
        paths += [path, pairs_path, names_path]
        done.append(now.filter(f"blocks > {level} and blocks <= {2 * level}"))
        level *= 2
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    out, _ = store(out.select("id", "sha", "blocks", "name", "copies"), "identities")
    release(spark, *paths)
    return out


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest key stays; a null key is smaller than any. Of rows that repeat
    the largest key exactly one is kept. Other columns are not looked at.
    """
    ids = identities(docs, key, text, block)
    keep = ids.groupBy("blocks", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    rows = split_join(ids, keep, ["name", "blocks"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Rows are told apart by key and text; of rows that repeat both one stays.
    """
    found = exact_dedup(docs, key, text).groupBy(F.col(key).alias("__id"), F.unhex("text_sha256").alias("__sha"))
    rows = found.agg(F.count(F.lit(1)).alias("__rows"), F.max("kept").alias("__kept")).filter("__rows > 1 or not __kept")
    rows, _ = store(rows, "touched")
    sha = free_name(docs, "sha")
    marked = with_text_column(docs, text, sha, BinaryType(), lambda: _sha)

    def same(other: DataFrame):
        return marked[key].cast("long").eqNullSafe(other["__id"]) & (marked[sha] == other["__sha"])

    repeated = rows.filter("__kept")
    single = marked.join(rows, same(rows), "left_anti")
    if repeated.isEmpty():  # no row is there twice: the documents are read once
        return single.drop(sha)
    one = marked.join(repeated, same(repeated), "left_semi").dropDuplicates([key, sha])
    return single.union(one).drop(sha)
