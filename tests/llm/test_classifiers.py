import math
import random
import zlib

import numpy as np
import pytest
from brute import SCHEMA, messy_rows
from pyspark.sql import functions as F

from tidegrid.llm import ranking, toxicity
from tidegrid.llm.boosting import fit_trees, isotonic
from tidegrid.llm.ranking import fit_pairs, fit_quality, with_quality
from tidegrid.llm.supervised import labelled_sample, remainder
from tidegrid.llm.toxicity import fit_toxicity, with_toxicity

BAD = "vile rotten nasty".split()


def _corpus(seed=2, many=240):
    """Every fifth text insults its reader, every fourth is noise."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(150)]
    docs, labels = [], []
    for i in range(many):
        w = [r.choice(words) for _ in range(r.randint(20, 60))]
        toxic, good = i % 5 == 1, i % 4 != 2
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), f"you {r.choice(BAD)}")
        if not good:
            w = [x + r.choice(["***", "%%%"]) for x in w] if i % 8 == 2 else [w[0]] * len(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = _corpus()
    labels += [(None, 1, 1), (3, None, None), (999, 1, 0), labels[1], labels[1]]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_remainder_is_crc32_of_the_text_of_the_key(spark):
    rows = spark.range(300).withColumn("r", remainder("id", 7)).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in rows)


def test_sample_is_bounded_and_follows_the_split(tables):
    docs, labels = tables
    train = remainder("doc_id", 4) != 2
    some = labelled_sample(docs, labels, "quality", train, rows=50)
    assert some.count() == 50
    every = labelled_sample(docs, labels, "quality", train, rows=10_000)
    assert every.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(240))


def test_sample_has_one_row_per_key(spark):
    docs = spark.createDataFrame([(i, f"text {i} {j}") for i in range(2) for j in range(500)] + [(0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), rows=2).collect()
    assert sorted(r.y for r in got) == [0, 1]
    assert sorted(got) == sorted(labelled_sample(docs.repartition(7), labels, "quality", F.lit(True), rows=2).collect())


def test_toxicity_on_held_out_labels(tables):
    docs, labels = tables
    model = fit_toxicity(docs, labels, remainder("doc_id", 5) != 0)
    assert set(BAD) <= set(model.lexicon)
    got = with_toxicity(docs, model).filter(remainder("doc_id", 5) == 0).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 1) for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    model = fit_quality(docs, labels, remainder("doc_id", 4) != 2)
    got = with_quality(docs, model).filter(remainder("doc_id", 4) == 2).collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 4 != 2) for r in got]) > 0.95


@pytest.mark.parametrize(("fit", "use", "alone"), [(fit_toxicity, with_toxicity, 0.0), (fit_quality, with_quality, 1.0)])
def test_awkward_rows_and_missing_labels(spark, tables, fit, use, alone):
    docs = spark.createDataFrame(messy_rows(), SCHEMA)
    model = fit(*tables, F.lit(True))
    out = use(docs, model, name="rank")
    assert out.columns == [*docs.columns, "rank"]
    got = out.collect()
    assert len(got) == docs.count() and all(0 <= r.rank <= 1 for r in got)
    assert len({r.rank for r in got if not r.text}) == 1  # null and empty score alike
    assert use(docs.filter("false"), model, name="rank").count() == 0
    none = fit(docs.filter("false"), tables[1], F.lit(True))
    assert {r.rank for r in use(docs, none, name="rank").collect()} == {alone}


def test_scores_do_not_depend_on_partitions(tables):
    docs, labels = tables
    models = [fit_quality(d, labels, F.lit(True)) for d in (docs.coalesce(1), docs.repartition(5))]
    assert np.allclose(models[0].weights, models[1].weights) and models[0].cut == pytest.approx(models[1].cut)


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(0)
    x = draw.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3)).astype(float)
    raw = fit_trees(x, y).raw(x)
    assert np.mean((raw > 0) == (y > 0)) > 0.99


def test_isotonic_against_pooling_by_definition():
    draw = np.random.default_rng(1)
    raw, y = draw.integers(0, 30, 200).astype(float), draw.integers(0, 2, 200).astype(float)
    knots, values = isotonic(raw, y)
    fit = np.interp(raw, knots, values)
    assert (np.diff(np.interp(np.sort(raw), knots, values)) >= -1e-12).all()
    # min-max formula of isotonic regression
    grid = np.unique(raw)
    for g in grid:
        lower = max(min(y[(raw >= a) & (raw <= b)].mean() for b in grid if b >= g) for a in grid if a <= g)
        assert np.interp(g, knots, values) == pytest.approx(lower)
    assert fit.mean() == pytest.approx(y.mean())


def test_pairs_order_the_better_side():
    draw = np.random.default_rng(3)
    good, bad = draw.normal(0.5, 1, (80, 3)), draw.normal(-0.5, 1, (30, 3))
    w = fit_pairs(good, bad, 4000)
    assert np.mean((good @ w)[:, None] > (bad @ w)[None, :]) > 0.8


def test_features_of_obfuscated_and_empty_words():
    words = toxicity._Words({"idiot": 2.0, "idio*": 1.0})
    assert words["1d10t!!"][0] == 2.0 and words["IDIOTS"][0] == 1.0 and words["IDIOTS"][1] & 2
    assert words["You,"][1] & 1 and words["***"][0] == 0
    x = toxicity.features_of([b"", b"you idiot"], words)
    assert x.shape == (2, toxicity.FEATURES) and x[1, 1] == 0.5 and math.isfinite(x.sum())
    assert ranking.features_of([b""]).shape == (1, 2 * ranking.RATES)


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    docs, labels = _corpus(many=400)
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, blocks = (fit_quality(docs, labels, F.lit(True), rows=n) for n in (1000, 70))
    x = ranking.features_of([r.text.encode() for r in docs.collect()])
    for model in (whole, blocks):  # statistics are those of all rows, whatever the size of a block
        assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(np.maximum(x.std(0), 1e-6))
        good = np.array([r.quality for r in labels.orderBy("doc_id").collect()], bool)
        ranks = np.sort(model.raw(x))
        assert model.cut == pytest.approx((ranks[(~good).sum() - 1] + ranks[(~good).sum()]) / 2)
        assert np.mean((model.score(x) >= 0.7) == good) > 0.95


def test_blocks_get_some_of_the_rarer_kind(spark):
    docs, labels = _corpus(many=400)
    labels = [(i, int(i not in (2, 6)), t) for i, _, t in labels]
    model = fit_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True), rows=50)
    z = model.raw(ranking.features_of([t.encode() for _, t in docs]))
    assert max(z[2], z[6]) < np.median(z) and model.constant is None
