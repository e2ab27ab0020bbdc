"""Nearest neighbours by inner product with a vantage-point tree per shard.

A vector gets one more component that brings it to the largest length of all, a query a zero: then the largest inner product is the
smallest distance, and the triangle inequality holds. Equal vectors are one entry with its smallest ids. Entries are dealt to shards
of a bounded size; a shard's tree halves it at the median distance from a vantage point down to leaves, which are one matrix product.
Shards are searched in rounds, each of more shards than the one before, and the radius that a query has reached goes along, so the
rows found grow with the logarithm of the number of shards.

The far side of a node is searched when the query is closer to its border than ``factor`` times its radius. Factor one is the triangle
inequality itself: the search is exact. Smaller factors search less and may miss neighbours.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows without id, nor
vectors of another length than most have (ties: the longer). Of rows with one id the smallest vector counts. Without queries or
candidates the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.store import release, split_join, store

#: Entries of a shard, queries that a task searches at once, entries of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 4096, 4096, 128

#: Shards of the first round, and how many times as many are done after each further one.
FIRST, MORE = 2, 4

#: The factor of the registered query; its recall is in the README and in the tests.
FACTOR = 0.15


def build_tree(vectors: np.ndarray, reach: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and nodes (from, to, vantage, border, inner child, outer child); a leaf has child -1.

    ``reach`` is the largest length of all vectors. The vantage point is the row farthest from the middle of its node.
    """
    lifted = np.column_stack([vectors, np.sqrt(np.maximum(0, reach**2 - (vectors**2).sum(1)))])
    order, nodes, todo = np.arange(len(vectors)), [[0, len(vectors), 0, 0.0, -1, -1]], [0]
    while todo:
        node = nodes[todo.pop()]
        lo, hi = int(node[0]), int(node[1])
        if hi - lo <= leaf:
            continue
        rows = lifted[order[lo:hi]]
        far = int(((rows - rows.mean(0)) ** 2).sum(1).argmax())
        distance = np.sqrt(((rows - rows[far]) ** 2).sum(1))
        by = np.argsort(distance, kind="stable")
        middle = (hi - lo) // 2
        node[2:] = [int(order[lo + far]), float(distance[by[middle]]), len(nodes), len(nodes) + 1]
        order[lo:hi] = order[lo:hi][by]
        todo += [len(nodes), len(nodes) + 1]
        nodes += [[lo, lo + middle, 0, 0.0, -1, -1], [lo + middle, hi, 0, 0.0, -1, -1]]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = np.array(nodes, np.float64)
    table[:, 2] = place[table[:, 2].astype(np.int64)]
    return order, table


def search_tree(vectors: np.ndarray, nodes: np.ndarray, reach: float, queries: np.ndarray, floor: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of queries and rows that may be among the ``k`` nearest, ties at the end included; and the number of products taken.

    ``vectors`` are in tree order; ``floor`` is an inner product that a query's ``k``-th neighbour is known to reach.
    """
    best = np.repeat(floor[:, None], k, 1)
    length = (queries**2).sum(1) + reach**2
    slack = 1e-9 * (1 + length)
    asked, met, values, products = [], [], [], 0

    def visit(at: int, who: np.ndarray) -> None:
        nonlocal products
        lo, hi, vantage, border, inner, outer = nodes[at]
        if inner < 0:
            found = queries[who] @ vectors[int(lo) : int(hi)].T
            products += found.size
            best[who] = np.partition(np.concatenate([best[who], found], 1), -k, 1)[:, -k:]
            q, row = np.nonzero(found >= (best[who].min(1) - slack[who])[:, None])
            asked.append(who[q])
            met.append(row + int(lo))
            values.append(found[q, row])
            return
        distance = np.sqrt(np.maximum(0, length[who] - 2 * (queries[who] @ vectors[int(vantage)])))
        products += len(who)
        inside = distance < border
        for side, chosen in ((inner, inside), (outer, ~inside)):
            if chosen.any():
                visit(int(side), who[chosen])
        radius = np.sqrt(np.maximum(0, length[who] - 2 * best[who].min(1)) + slack[who])
        across = np.abs(distance - border) <= factor * radius
        for side, chosen in ((outer, inside & across), (inner, ~inside & across)):
            if chosen.any():
                visit(int(side), who[chosen])

    if len(queries):
        visit(0, np.arange(len(queries)))
    if not asked:
        return np.empty(0, np.int64), np.empty(0, np.int64), products
    q, row, value = np.concatenate(asked), np.concatenate(met), np.concatenate(values)
    kept = value >= best.min(1)[q] - slack[q]
    return q[kept], row[kept], products


def _blob(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)


def _built(reach: float):
    """A shard's rows as one row: vectors in tree order, nodes, ids of each entry."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("entry").to_numpy())))
        vectors = _matrix(rows.column("vec"))
        order, nodes = build_tree(vectors, reach)
        ids = rows.column("ids").combine_chunks().take(pa.array(order))
        counts = np.diff(ids.offsets.to_numpy())
        arrays = [rows.column("shard").combine_chunks().slice(0, 1), _blob(vectors[order]), _blob(nodes), _blob(ids.flatten().to_numpy()), _blob(counts.astype(np.int64))]
        return pa.Table.from_arrays(arrays, ["shard", "vectors", "nodes", "ids", "counts"])

    return run


def _searched(k: int, factor: float, reach: float):
    """The ``k`` best ids of one shard for each query of a block."""

    def run(trees: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if trees.num_rows and asks.num_rows:
            queries, names = _matrix(asks.column("vec")), asks.column("ask").to_numpy()
            floor = asks.column("floor").to_numpy(zero_copy_only=False)
            raw = {c: trees.column(c)[0].as_py() for c in ("vectors", "nodes", "ids", "counts")}
            vectors = np.frombuffer(raw["vectors"]).reshape(-1, queries.shape[1])
            counts, ids = np.frombuffer(raw["counts"], np.int64), np.frombuffer(raw["ids"], np.int64)
            q, row, _ = search_tree(vectors, np.frombuffer(raw["nodes"]).reshape(-1, 6), reach, queries, floor, k, factor)
            # row by row, so that equal vectors have equal scores
            score = np.concatenate([np.empty(0), *((queries[q[i : i + 8192]] * vectors[row[i : i + 8192]]).sum(1) for i in range(0, len(q), 8192))])
            many = counts[row]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat((np.cumsum(counts) - counts)[row], many)
            q, score, one = np.repeat(q, many), np.repeat(score, many), ids[at]
            order = np.lexsort((one, -score, q))
            q, score, one = q[order], score[order], one[order]
            first = np.searchsorted(q, q)
            top = (np.arange(len(q)) - first < k) & (score >= floor[q])
            found.append((names[q[top]], one[top], score[top]))
        ask, one, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"ask": ask, "vec_id": one, "score": score})

    return run


def _usable(vec: Column) -> Column:
    number = F.transform(vec, lambda x: x.cast("double"))
    odd = F.exists(number, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce(~odd & F.exists(number, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """For each query row its ``k`` nearest other rows by inner product: query_id, rank from 1, vec_id, score; ties to the smaller id."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(key).isNotNull() & _usable(F.col(vec))).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), is_query.alias("asks"))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    single, single_at = store(rows.filter(F.size("vec") == (sizes.size if sizes else 0)).groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")).withColumn("hash", F.xxhash64("vec")), "vectors")
    # equal vectors: the k + 1 smallest ids are enough for any query
    few = Window.partitionBy("hash", "vec").orderBy("id")
    same = single.withColumn("at", F.row_number().over(few)).filter(F.col("at") <= k + 1).groupBy("hash", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries, entries_at = store(same.withColumn("entry", F.col("ids")[0]), "entries")
    top = entries.agg(F.count("*").alias("rows"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    reach, shards = float(np.sqrt(top.most or 0.0)) * (1 + 1e-12), max(1, -(-top.rows // SHARD_ROWS))
    dealt = entries.select("entry", "vec", "ids", F.pmod(F.xxhash64("entry"), F.lit(shards)).alias("shard"))
    trees, trees_at = store(dealt.groupBy("shard").applyInArrow(_built(reach), "shard long, vectors binary, nodes binary, ids binary, counts binary"), "trees")
    queries = single.filter("asks").select("id", "hash", "vec")
    asks, asks_at = store(queries.groupBy("hash", "vec").agg(F.min("id").alias("ask")), "asked-vectors")
    blocks = max(1, -(-asks.count() // BLOCK_ROWS))
    best, best_at = store(spark.createDataFrame([], "ask long, vec_id long, score double"), "nearest")
    at, step, wanted = 0, FIRST, k + 1
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    while at < shards:
        until = min(shards, at + step)
        reached = best.groupBy("ask").agg(F.when(F.count("*") >= wanted, F.min("score")).alias("floor"))
        going = asks.select("ask", "vec").join(reached, "ask", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        to_shards = going.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(at).cast("long"), F.lit(until - 1).cast("long"))))
        to_blocks = trees.filter(F.col("shard").between(at, until - 1)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = to_blocks.groupBy("shard", "block").cogroup(to_shards.groupBy("shard", "block")).applyInArrow(_searched(wanted, factor, reach), "ask long, vec_id long, score double")
        merged = best.unionByName(found).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= wanted).drop("at")
        last = best_at
        best, best_at = store(merged, "nearest")
        release(spark, last)
        at, step = until, until * (MORE - 1)
    named = split_join(queries, asks, ["hash", "vec"]).select("id", "ask")
    others = split_join(named, best, ["ask"]).filter("vec_id <> id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    result, _ = store(others.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score"), "neighbours")
    release(spark, single_at, entries_at, trees_at, asks_at, best_at)
    return result
