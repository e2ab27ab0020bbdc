import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from brute import A_Z, SCHEMA, components, messy_rows, shingles
from pyspark.sql import functions as F

from tidegrid.llm import jaccard_join
from tidegrid.llm.components import components as spark_components
from tidegrid.llm.exact_dedup import drop_copies, exact_dedup
from tidegrid.llm.jaccard_join import jaccard_components, one_of_each
from tidegrid.llm.shingles import fingerprints, shingle_sets


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


def test_shingle_hashes_follow_the_definition():
    texts = [t for _, t, *_ in messy_rows(4)]
    flat, sizes = shingle_sets([(t or "").encode() for t in texts], 4)
    assert sizes.tolist() == [len(shingles(t, 4)) for t in texts]
    fp = fingerprints(flat, sizes)
    sets = [shingles(t, 4) for t in texts]
    assert all((fp[i] == fp[j]) == (sets[i] == sets[j]) for i in range(0, len(texts), 5) for j in range(len(texts)))


def test_words_of_any_length_cross_the_pieces(monkeypatch):
    from tidegrid.llm import shingles as module

    text = ("ab " * 50 + "y" * 300 + " c").encode()
    whole = shingle_sets([text, b"q r s t"], 2)[0]
    monkeypatch.setattr(module, "_PIECE", 64)
    assert (shingle_sets([text, b"q r s t"], 2)[0] == whole).all()


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_components_against_all_pairs(spark, docs, width, num, den):
    got = jaccard_components(docs, width=width, num=num, den=den).collect()
    want = components([(r.doc_id, r.text) for r in docs.collect()], width, num, den)
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, n, c) for i, (n, c) in want.items()}
    assert sum(v == 3 for v in Counter(r.doc_id for r in got).values()) >= 1  # repeated rows stay


def test_one_group_of_near_copies_over_small_cells(spark, monkeypatch):
    """Leaders, runs, closest pairs and blocks all have to share the work; nothing may be lost."""
    for name, value in (("LEADERS", 2), ("RUN_ROWS", 15), ("CELL_ROWS", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 2, 3, 4, 6])):
            w[r.randrange(60)] = f"n{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=80, den=100).collect()
    want = components(rows, 3, 80, 100)
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}
    assert 1 < len({c for _, c in want.values()}) < 120


def test_links_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found, _ = spark_components(spark.createDataFrame(chain, "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def _plain_dedup(rows):
    low = {}
    for i, t in rows:
        low.setdefault((t or "").translate(A_Z), []).append(i)
    return low


@pytest.mark.parametrize("block", [7, 2048])
def test_exact_dedup_against_grouping(docs, block):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = _plain_dedup(rows)
    got = exact_dedup(docs, block=block).collect()
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, max(known) if known else None, len(ids), sha) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_clashing_handles_are_told_apart(docs):
    from tidegrid.llm.exact_dedup import identities

    plain = identities(docs, block=16)
    clash = identities(docs, block=16, handle=F.crc32("content") % 5)
    classes = [{tuple(sorted((r.id or 0, bytes(r.sha)) for r in g)) for g in _by_name(ids)} for ids in (plain, clash)]
    assert classes[0] == classes[1]


def _by_name(ids):
    groups = {}
    for r in ids.collect():
        groups.setdefault((r.blocks, r.name), []).append(r)
    return groups.values()


def test_stages_keep_columns_and_one_row_of_each(docs):
    once = drop_copies(docs)
    assert once.columns == docs.columns
    rows = once.collect()
    assert sorted((r.text or "").translate(A_Z) for r in rows) == sorted(_plain_dedup([(r.doc_id, r.text) for r in docs.collect()]))
    near = one_of_each(once)
    assert near.columns == docs.columns
    want = components([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    assert {r.doc_id for r in near.collect() if r.doc_id is not None} == {c for _, c in want.values()}


def test_texts_that_share_a_key_stay_with_their_own_group(spark):
    a, b = ("alpha beta gamma delta epsilon zeta eta theta iota kappa".split() for _ in range(2))
    b = [w.upper()[::-1] for w in b]
    rows = [(5, " ".join(a)), (7, " ".join(a).upper()), (5, " ".join(b)), (3, " ".join(b) + " "), (None, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, one_of_each(docs).collect()), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    for op in (jaccard_components, exact_dedup, drop_copies, one_of_each):
        assert op(none).count() == 0


def test_hash_mixing_is_a_bijection_on_a_sample():
    from tidegrid.llm.store import mix

    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(mix(x, 3))) == len(x)
