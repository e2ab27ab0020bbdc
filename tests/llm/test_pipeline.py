from collections import Counter

import pytest
from brute import A_Z, components

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage over the smallest tables, with clashing extra columns."""
    from tidegrid.llm.store import store, table

    docs = table(spark, SMALL, "documents").selectExpr("*", "1 as score", "'x' as sha")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = store(stage(spark, docs, SMALL), f"test-{name}")
        out.append(docs)
    return out


def test_columns_and_shrinking(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_copies", "near_copies", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[-1] == ids[-2]


def test_each_stage_does_its_part(spark, stages):
    rows = [{r.doc_id: r.text for r in d.collect()} for d in stages[:-1]]
    low = Counter((t or "").translate(A_Z) for t in rows[2].values())
    assert len(rows[3]) == len(low) and Counter((t or "").translate(A_Z) for t in rows[3].values()) == Counter(low.keys())
    assert all(i == max(j for j, t in rows[2].items() if (t or "").translate(A_Z) == (rows[3][i] or "").translate(A_Z)) for i in rows[3])
    assert set(rows[4]) == {c for _, c in components(list(rows[3].items()), 5, 80, 100).values()}


def test_packed_tokens_are_whole(stages):
    got = stages[-1].collect()
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_registered():
    names = list(queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert {"op3_exact_dedup", "op8_chat_formatting"} <= set(oracle_sql())


def test_queries_match_their_sql(spark):
    from oracle_compare import compare, duck

    con = duck(SMALL)
    for name in ("op3_exact_dedup", "op8_chat_formatting"):
        ok, note = compare(queries()[name](spark, SMALL), con, oracle_sql()[name])
        assert ok, note
