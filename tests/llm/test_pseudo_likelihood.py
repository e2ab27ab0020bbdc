import math
import uuid
from collections import Counter

import numpy as np
import pytest
from brute import SCHEMA, messy_rows
from pyspark.sql import functions as F

from tidegrid.llm import pseudo_likelihood as P


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


def _plain_score(net, vocabulary, text):
    """Sum over tokens of the log of a softmax, one token at a time."""
    h, _ = P.word_hashes([(text or "").encode()])
    ids = [int(x) for x in vocabulary.ids(h)]
    total = 0.0
    for i, own in enumerate(ids):
        z = np.zeros(P.WIDTH)
        for place, off in enumerate(P.OFFSETS):
            z = z + net.embed[place][ids[i + off] if 0 <= i + off < len(ids) else P.PAD]
        logits = np.tanh(z) @ net.out + net.bias
        total += logits[own] - math.log(np.exp(logits).sum())
    return len(ids), total


def test_scores_against_single_tokens(docs):
    vocabulary, frequency = P.count_words(docs)
    net = P.new_window(frequency)
    short = docs.filter("text is null or length(text) < 2000")
    got = Counter((r.doc_id, r.n_tokens, round(r.log_likelihood, 2)) for r in P.pseudo_likelihood(short, net, vocabulary).collect())
    want = Counter()
    for r in short.collect():
        n, s = _plain_score(net, vocabulary, r.text)
        want[(r.doc_id, n, round(s, 2))] += 1
    assert {k[:2] for k in got} == {k[:2] for k in want}
    assert sum(k[2] for k in got.elements()) == pytest.approx(sum(k[2] for k in want.elements()), rel=1e-3)


def test_counts_cover_all_documents(docs):
    _, frequency = P.count_words(docs)
    words = Counter(w for r in docs.collect() for w in (r.text or "").lower().split(" ") if w.strip())
    assert frequency.sum() == sum(len((r.text or "").split()) for r in docs.collect())
    assert sorted(frequency[: P.KNOWN])[-1] == max(words.values())


def test_training_beats_frequencies(spark):
    r = np.random.default_rng(1)
    chain = {i: r.integers(0, 40, 2) for i in range(40)}
    rows = []
    for d in range(400):
        w = [int(r.integers(0, 40))]
        for _ in range(60):
            w.append(int(r.choice(chain[w[-1]])))
        rows.append((d, " ".join(f"v{x}" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary, frequency = P.count_words(docs)

    def per_token(net):
        a = P.pseudo_likelihood(docs, net, vocabulary).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
        return a[0] / a[1]

    flat = P.new_window(frequency)
    flat.out[:] = 0
    net = P.train(docs, vocabulary, frequency, rounds=2, share=2)
    assert per_token(net) > per_token(flat) + 0.5
    swapped = docs.withColumn("text", F.concat_ws(" ", F.shuffle(F.split("text", " "))))
    order = P.pseudo_likelihood(swapped, net, vocabulary).agg(F.sum("log_likelihood")).first()[0]
    assert order < P.pseudo_likelihood(docs, net, vocabulary).agg(F.sum("log_likelihood")).first()[0]


def test_every_document_is_trained_on_once(spark, tmp_path):
    docs = spark.createDataFrame([(i // 2 if i % 5 else None, f"only{i} word{i % 3}") for i in range(200)], "doc_id long, text string").repartition(3)
    vocabulary, frequency = P.count_words(docs)
    seen = str(tmp_path)

    def padded(self, texts):
        with open(f"{seen}/{uuid.uuid4().hex}", "wb") as f:
            f.write(b"\n".join(texts))
        return P.Vocabulary.padded(self, texts)

    logged = type("Logged", (), {"padded": padded, "words": vocabulary.words, "types": vocabulary.types, "ids": P.Vocabulary.ids})()
    P.train(docs, logged, frequency)
    got = Counter(t for f in tmp_path.iterdir() for t in f.read_text().split("\n"))
    assert got == Counter(r.text for r in docs.collect())


def test_words_that_share_a_type_have_their_own_probability(docs):
    vocabulary, frequency = P.count_words(docs)
    net = P.new_window(frequency)
    n = Counter(x for r in docs.collect() for x in P.word_hashes([(r.text or "").encode()])[0].tolist())
    short = docs.filter("text is null or length(text) < 2000")
    got = sorted((r.doc_id or -1, r.n_tokens, r.log_likelihood) for r in P.token_likelihood(short, net, vocabulary, frequency).collect())
    want = []
    for r in short.collect():
        many, total = _plain_score(net, vocabulary, r.text)
        h = P.word_hashes([(r.text or "").encode()])[0]
        total += sum(math.log(n[x] / (frequency[t] + 1)) for x, t in zip(h.tolist(), vocabulary.ids(h)) if t >= P.KNOWN)
        want.append((r.doc_id or -1, many, total))
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-3, abs=1e-2)
    known = [f"w{i}" for i in range(400)]
    h = P.word_hashes([" ".join(known).encode()])[0]
    rare = next(w for w, t in zip(known, vocabulary.ids(h)) if t >= P.KNOWN)
    two = docs.sparkSession.createDataFrame([(1, rare), (2, next(x for i in range(10**6) if vocabulary.ids(P.word_hashes([(x := f"invented{i}").encode()])[0])[0] == vocabulary.ids(P.word_hashes([rare.encode()])[0])[0]))], "doc_id long, text string")
    a, b = (r.log_likelihood for r in P.token_likelihood(two, net, vocabulary, frequency).orderBy("doc_id").collect())
    assert a > b + 0.5


def test_a_step_moves_every_row_that_the_places_around_a_token_use():
    r = np.random.default_rng(3)
    net, plain = P.new_window(np.ones(P.TYPES)), P.new_window(np.ones(P.TYPES))
    ids = r.integers(0, 12, 90)  # rows are used many times in one step
    at = np.arange(P.SIDE, 90 - P.SIDE)
    P.Trainer(net).step(ids, at)
    h = np.tanh(sum(plain.embed[p][ids[at + off]] for p, off in enumerate(P.OFFSETS)))
    z = np.exp(h @ plain.out + plain.bias)
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(at)), ids[at]] -= 1
    g, back = np.zeros_like(plain.embed), z @ plain.out.T * (1 - h * h) / len(at)
    for i in range(len(at)):
        for p, off in enumerate(P.OFFSETS):
            g[p, ids[at[i] + off]] += back[i]
    assert net.embed == pytest.approx(plain.embed - P.STEP * g / np.sqrt(1e-4 + g * g), abs=1e-5)


def test_only_rare_words_are_joined(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "KNOWN", 2)
    monkeypatch.setattr(P, "OFTEN", 40)
    vocabulary, frequency = P.count_words(docs)
    n = Counter(x for r in docs.collect() for x in P.word_hashes([(r.text or "").encode()])[0].tolist())
    often = dict(zip(vocabulary.often.tolist(), vocabulary.often_n.tolist()))
    assert 0 < len(often) <= 40 and often == {w: n[w] for w in often}
    assert min(often.values()) >= max(c for w, c in n.items() if w not in often)
    net = P.new_window(frequency)
    alone = P.Vocabulary(vocabulary.words, vocabulary.types, vocabulary.counts)

    def scores(v):
        return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.log_likelihood, 4)) for r in P.token_likelihood(docs, net, v, frequency).collect())

    for a, b in zip(scores(vocabulary), scores(alone), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-3)
    # with a table that has no words, the frequent ones keep their counts
    spark.createDataFrame([], "word long, n long").write.parquet(f"{tmp_path}/none")
    few = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    h = P.word_hashes([b"x"])[0]
    kept = P.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), f"{tmp_path}/none", h, np.array([1000]))
    lost = P.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), f"{tmp_path}/none")
    a, b = (P.token_likelihood(few, net, v, frequency).first().log_likelihood for v in (kept, lost))
    assert a - b == pytest.approx(math.log(1000))


def test_no_documents(docs):
    none = docs.filter("false")
    vocabulary, frequency = P.count_words(none)
    net = P.train(none, vocabulary, frequency)
    assert P.pseudo_likelihood(none, net, vocabulary).count() == 0
    got = P.pseudo_likelihood(docs.filter("text is null"), net, vocabulary).collect()
    assert got and all(r.n_tokens == 0 and r.log_likelihood == 0 and r.per_token is None for r in got)


@pytest.mark.parametrize("size", [1, 300])
def test_exponentials_without_a_maximum_where_none_is_needed(size):
    r = np.random.default_rng(4)
    net = P.new_window(np.ones(P.TYPES))
    net.out[:] = r.normal(0, size, net.out.shape)
    net.bias[:] = r.normal(0, size, P.TYPES)
    embed, out, bias = net.embed.astype(float), net.out.astype(float), net.bias.astype(float)
    ids = r.integers(0, P.TYPES, 90)
    at = np.arange(P.SIDE, 90 - P.SIDE)
    h = np.tanh(sum(embed[p][ids[at + off]] for p, off in enumerate(P.OFFSETS)))
    z = h @ out + bias
    got = net.scores(np.column_stack([h, np.ones(len(at))]).astype(np.float32))
    # one matrix product brings the scores and the bias; only scores that are large are lowered by their maximum
    assert got == pytest.approx(z if size == 1 else z - z.max(1, keepdims=True), rel=1e-3, abs=1e-2)
    log_sum = z.max(1) + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
    assert net.log_probabilities(ids, at) == pytest.approx(z[np.arange(len(at)), ids[at]] - log_sum, rel=1e-3, abs=1e-2)
    p = np.exp(z - log_sum[:, None])
    p[np.arange(len(at)), ids[at]] -= 1
    g = np.vstack([h.T @ p, p.sum(0)]) / len(at)
    back, rows = p @ out.T * (1 - h * h) / len(at), np.zeros_like(embed)
    for i in range(len(at)):
        for place, off in enumerate(P.OFFSETS):
            rows[place, ids[at[i] + off]] += back[i]
    P.Trainer(net).step(ids, at)
    assert net.head == pytest.approx(np.vstack([out, bias]) - P.STEP * g / np.sqrt(1e-4 + g * g), rel=1e-4, abs=1e-3)
    assert net.embed == pytest.approx(embed - P.STEP * rows / np.sqrt(1e-4 + rows * rows), abs=1e-3)
