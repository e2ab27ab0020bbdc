import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import SCHEMA, messy_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidegrid.llm import impact_search, vantage_trees
from tidegrid.llm.impact_search import nra, rank_documents
from tidegrid.llm.queries import SQL, op11_ranked_search, op12_vantage_trees
from tidegrid.llm.vantage_trees import build_tree, nearest, search_tree

SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 6), max_size=30), max_size=5), st.integers(1, 5), st.integers(1, 4))
def test_nra_is_a_sort_of_the_sums(lists, k, first):
    sums = Counter()
    for x in lists:
        sums.update(x)
    want = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:k]
    sorted_lists = [sorted(x.items(), key=lambda y: -y[1]) for x in lists]
    got = nra([(np.array([d for d, _ in x], np.int64), np.array([g for _, g in x], np.int64)) for x in sorted_lists], 31, k, first)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_nra_stops_before_the_end_of_the_lists():
    gains = np.arange(100_000, 0, -1)

    class Watched(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Watched.read = max(Watched.read, at.stop)
            return super().__getitem__(at)

    nra([(np.arange(100_000), gains.view(Watched))] * 2, 100_000, 10)
    assert 0 < Watched.read < 1000


def _terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def _ranking(docs, items, k=10):
    """(item, rank, doc, score) of rows (doc_id, text) and (item_id, text)."""
    counts = [(i, t, Counter(_terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, _, c in counts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, _, c in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(_terms(t))
    out = set()
    for item, words in asked.items():
        scores = set()
        for doc, text, c in counts:
            size = sum(c.values())
            if doc is not None and size:
                m = 25 + 75 * size * n // total
                score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in words.items() if c[t])
                if score:
                    scores.add((-score, doc, text))
        out |= {(item, r, d, -s) for r, (s, d, _) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("shard, block", [(500_000, 500_000), (300, 20)])
def test_ranking_of_awkward_rows(spark, monkeypatch, shard, block):
    monkeypatch.setattr(impact_search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(impact_search, "BLOCK_TERMS", block)
    rows = messy_rows()
    r = random.Random(3)
    items = [(i, " ".join(r.choice(((t or "") + " none").split()) for _ in range(12))) for i, (_, t, *_) in enumerate(rows[:20])]
    items += [(3, None), (4, ""), (5, "w1 w2 w1 É"), (5, "w1 w2 w1 É"), (None, "w7 w7"), (90, "never-seen words")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("item", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(None).cast("int"))
    got = rank_documents(docs, asked).collect()
    want = _ranking([(x[0], x[1]) for x in rows], items)
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame(messy_rows(many=5), SCHEMA), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert rank_documents(docs.filter("false"), items).count() == 0
    assert rank_documents(docs, items.filter("false")).count() == 0
    assert rank_documents(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_query_11_next_to_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        path = f"{SF}/{name}.parquet"
        db.register(name, spark.read.parquet(path).toArrow())
    want = sorted(db.execute(SQL["op11_ranked_search"]).fetchall())
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in op11_ranked_search(spark, SF).collect())
    columns = [x[0] for x in db.description]
    at = [columns.index(c) for c in ("item_id", "rank", "doc_id", "score")]
    assert got == [tuple(w[i] for i in at) for w in want] and got


def _sphere(n, seed=0, groups=40):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, 16))
    return middle[r.integers(groups, size=n)] + 0.4 * r.normal(size=(n, 16))


def test_tree_with_factor_one_is_exact():
    v = _sphere(3000)
    reach = float(np.sqrt((v**2).sum(1).max()))
    order, nodes = build_tree(v, reach, leaf=32)
    assert sorted(order) == list(range(3000))
    products = {}
    for factor in (1.0, 0.5):
        q, row, products[factor] = search_tree(v[order], nodes, reach, v[:100], np.full(100, -np.inf), 10, factor)
        got = defaultdict(set)
        for a, b in zip(q, row, strict=True):
            got[a].add(order[b])
        want = [set(np.argsort(-(v @ v[i]), kind="stable")[:10]) for i in range(100)]
        recall = sum(len(got[i] & want[i]) for i in range(100)) / 1000
        assert recall == 1.0 if factor == 1.0 else recall >= 0.9
    assert products[0.5] < products[1.0] <= 3000 * 100 * 1.1


def _brute(rows, k):
    kept = {}
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok and len(v) == 3:
            kept[i] = min(kept.get(i, v), v)
    out = []
    for i in kept:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(kept[i], v, strict=True)), j) for j, v in kept.items() if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(4096, 4096), (9, 3)])
def test_neighbours_of_awkward_rows(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vantage_trees, "SHARD_ROWS", shard)
    monkeypatch.setattr(vantage_trees, "BLOCK_ROWS", block)
    r = random.Random(1)
    rows = [(i, [float(r.randrange(-4, 5)) for _ in range(3)]) for i in range(150)]  # many ties and equal vectors
    rows += [(i, [1.0, 2.0, 2.0]) for i in range(200, 300)] + [rows[20], (20, [3.0, 3.0, 3.0]), (None, [1.0, 1.0, 1.0]), (500, None), (520, []), (540, [0.0, 0.0, 0.0])]
    rows += [(560, [1.0, None, 1.0]), (580, [1.0, float("nan"), 1.0]), (600, [float("inf"), 0.0, 0.0]), (620, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)).withColumn("score", F.lit("x"))
    got = sorted(tuple(x) for x in nearest(vectors, F.col("vec_id") % 20 == 0, 7, factor=1.0).collect())
    assert got == _brute(rows, 7)
    assert nearest(vectors.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(vectors.filter("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(vectors.filter("vec_id = 40"), F.col("vec_id") % 20 == 0).count() == 0


def test_query_12_recall(spark, monkeypatch):
    monkeypatch.setattr(vantage_trees, "SHARD_ROWS", 200)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], np.float64)
    got = defaultdict(list)
    for r in op12_vantage_trees(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id]) and abs(r.score - float(v[r.query_id] @ v[r.vec_id])) < 1e-12
    hits = 0
    for i in range(0, len(v), 20):
        s = v @ v[i]
        s[i] = -np.inf
        hits += len({j for j, _ in got[i]} & set(np.argsort(-s)[:20].tolist()))
        assert len(got[i]) == 20 and [s for _, s in got[i]] == sorted((s for _, s in got[i]), reverse=True)
    assert hits / (20 * len(got)) >= 0.9 and len(got) == len(v) // 20
