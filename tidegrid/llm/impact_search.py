"""Ranked lexical search without random access: impact-sorted lists are read in turn until the best documents are certain.

Documents are counted once: every row of the stored postings is a term of some item in one document, and an empty term carries the
document's length, from which the corpus counts come. Documents are dealt to shards of a bounded number of postings; in a shard each
term has a list sorted by impact, and every item keeps a lower and an upper bound of each document's score (`nra`). The best of all
shards are the best of the corpus.

Defined results: null and empty texts hold no terms and are counted nowhere. Documents without an id count in the corpus but are
never found. A row repeated with id and text counts each time in the corpus and is found once; other texts under one id are
documents of their own. Repeated items count once, and other texts under one item id are one item together. Without items, or
without terms in the corpus, the result is empty. Other columns of either table are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.store import byte_texts, chunks, list_column, release, store

#: Bytes of a term: the ASCII letters and digits, and all of any other character.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: Postings of one shard, which are in memory together, and rows of item terms of one block.
SHARD_POSTINGS, BLOCK_TERMS = 500_000, 500_000

#: Postings that the first round reads of each list; every round doubles it.
FIRST = 128

_COUNTED = "h long, n long, terms array<binary>, tfs array<long>"


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, a hash of the text, its number of terms, and the distinct terms with their counts."""
    kind = df.schema[key]
    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b.column(2))
            for lo, hi in chunks(texts):
                found = [Counter(TERM.findall(x.lower())) for x in texts[lo:hi]]
                sizes = np.array([len(c) for c in found], np.int64)
                tfs = np.fromiter((v for c in found for v in c.values()), np.int64, int(sizes.sum()))
                n = np.array([sum(c.values()) for c in found], np.int64)
                terms = list_column([t for c in found for t in c], sizes, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n), terms, list_column(tfs, sizes, pa.int64())], ["key", "h", "n", "terms", "tfs"])

    schema = T.StructType([T.StructField("key", kind.dataType), *T._parse_datatype_string(_COUNTED).fields])
    return rows.mapInArrow(run, schema)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of the highest sums, higher sums first, ties to the smaller number; and the sums.

    A list holds distinct document numbers and their gains, falling and above 0. Lists are read from the front only. A document's
    sum lies between what was read of it and that plus the next gains of the lists where it was not met. Reading ends when no
    document that is unknown, or whose sum is open, can reach the sum of the ``k``-th.
    """
    lower = np.zeros(n_docs, np.int64)
    seen = np.zeros((len(lists), n_docs), bool)
    ahead = np.array([g[0] if len(g) else 0 for _, g in lists], np.int64)
    at, step = 0, first
    while True:
        for i, (docs, gains) in enumerate(lists):
            if ahead[i]:
                part = docs[at : at + step]
                lower[part] += gains[at : at + step]
                seen[i, part] = True
                ahead[i] = gains[at + step] if at + step < len(gains) else 0
        at, step = at + step, step * 2
        met = np.flatnonzero(lower)
        kth = max(1, np.partition(lower[met], len(met) - k)[len(met) - k]) if len(met) >= k else 1
        if ahead.sum() >= kth:  # a document that no list has shown yet may belong or tie
            continue
        upper = lower[met] + ahead @ ~seen[:, met]
        able = met[upper >= kth]
        if (upper[upper >= kth] == lower[able]).all():
            best = able[np.lexsort((able, -lower[able]))][:k]
            return best, lower[best]


def _search_shard(k: int, n_corpus: int, l_corpus: int):
    """A kernel for the postings of one shard and one block of items."""

    def run(postings: pa.Table, items: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if postings.num_rows and items.num_rows:
            doc, h, n, code, tf = (postings.column(c).to_numpy() for c in ("doc_id", "h", "n", "code", "tf"))
            order = np.lexsort((code, h, doc))
            doc, h, n, code, tf = doc[order], h[order], n[order], code[order], tf[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            number = np.cumsum(new) - 1
            ids = doc[new]
            once = np.ones(len(doc), bool)  # a repeated row has each posting several times
            once[1:] = new[1:] | (code[1:] != code[:-1])
            number, code, tf, n = number[once], code[once], tf[once], n[once]
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_corpus) // l_corpus))
            order = np.lexsort((number, -impact, code))
            number, code, impact = number[order], code[order], impact[order]
            for i, (codes, weights) in enumerate(zip(items.column("codes"), items.column("weights"), strict=True)):
                wanted = np.array(codes.as_py(), np.int64)
                ends = zip(np.searchsorted(code, wanted), np.searchsorted(code, wanted, "right"), weights.as_py(), strict=True)
                lists = [(number[lo:hi], w * impact[lo:hi]) for lo, hi, w in ends if hi > lo]
                if lists:
                    best, sums = nra(lists, len(ids), k)
                    out[0].append(np.full(len(best), i))
                    out[1].append(ids[best])
                    out[2].append(sums)
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table({"item": items.column("item").take(pa.array(flat[0])), "doc_id": pa.array(flat[1], pa.int64()), "score": pa.array(flat[2], pa.int64())})

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", asked: str = "text") -> DataFrame:
    """For each item its ``k`` best documents with a score above 0: item, rank from 1, doc_id, score; equal scores by ascending doc_id.

    The statement of the scores is that of `term_counts` (terms) and `_search_shard` (impacts); a term weighs
    ``floor(1000 * ln((2N + 2) / (2df + 1)))`` for each time that the item has it.
    """
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    counted = term_counts(items.select(item, asked).distinct(), item, asked)
    rows = counted.select("key", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).groupBy("key", F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("times"))
    wanted, wanted_at = store(rows, "item-terms")
    terms = wanted.select("term").distinct().unionByName(spark.range(1).select(F.lit(b"").alias("term")))
    seed = 0
    while True:  # a number for each term, without two terms that share one
        numbers, numbers_at = store(terms.select("term", F.xxhash64(F.lit(seed), "term").alias("code")), "term-codes")
        if numbers.select("code").distinct().count() == numbers.count():
            break
        seed += 1
    each = term_counts(docs, doc, text)
    listed = F.arrays_zip(F.concat(F.array(F.lit(b"")), "terms").alias("terms"), F.concat(F.array("n"), "tfs").alias("tfs"))
    found = each.select(F.col("key").cast("long").alias("doc_id"), "h", "n", F.explode(listed).alias("t")).select("doc_id", "h", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    postings, postings_at = store(found.filter("tf > 0").join(numbers, "term").select("doc_id", "h", "n", "code", "tf"), "postings")
    totals, totals_at = store(postings.groupBy("code").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.count("doc_id").alias("rows")), "term-totals")
    whole = totals.join(numbers.filter("term = X''"), "code").select("df", "total").first()
    n_corpus, l_corpus = (int(whole.df), int(whole.total)) if whole else (0, 0)
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_corpus + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    weighed = wanted.join(numbers, "term").join(totals, "code").select("key", "code", weight.alias("weight")).filter("weight > 0")
    size, blocks = totals.join(numbers.filter("term <> X''"), "code").agg(F.sum("rows")).first()[0] or 0, -(-max(1, wanted.count()) // BLOCK_TERMS)
    shards = max(1, -(-size // SHARD_POSTINGS))
    packed = weighed.groupBy(F.col("key").alias("item")).agg(F.collect_list(F.struct("code", "weight")).alias("t"))
    every = packed.select("item", F.col("t.code").alias("codes"), F.col("t.weight").alias("weights"), F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
    questions = every.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    # the empty term and terms that add nothing are not read; documents without id cannot be found
    lists = postings.filter("doc_id is not null").join(weighed.select("code").distinct(), "code", "left_semi")
    dealt = lists.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    near = dealt.groupBy("shard", "block").cogroup(questions.groupBy("shard", "block")).applyInArrow(_search_shard(k, n_corpus, l_corpus), schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best, _ = store(near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "ranked")
    release(spark, wanted_at, numbers_at, postings_at, totals_at)
    return best.select(F.col("item").alias(item), "rank", "doc_id", "score")
