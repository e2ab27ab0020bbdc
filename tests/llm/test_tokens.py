import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import SCHEMA, messy_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tidegrid.llm import lexical_packing as packing
from tidegrid.llm.bpe import WordBpe, encode_decode
from tidegrid.llm.lexical_packing import Bm25, fill_windows, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = WordBpe(open(PATH, "rb").read())


def _ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    ids = OWN.encode(text)
    assert list(memoryview(ids).cast("I")) == _ids(text)
    assert OWN.decode(ids) == LIBRARY.decode(_ids(text), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["x<|startoftext|>y <|endoftext|>", "ΑΣ ΟΣ", "it's DON'T we'll", "１２ ½ ²", "a\x1cb\x85c​d", "İstanbul", "ab" * 3000, "é", " \t\n"])
def test_corner_cases_as_the_library(text):
    assert list(memoryview(OWN.encode(text)).cast("I")) == _ids(text)


def test_memo_may_be_emptied(monkeypatch):
    monkeypatch.setattr("tidegrid.llm.bpe.MEMO", 2)
    text = "one two three four two one five"
    assert list(memoryview(WordBpe(open(PATH, "rb").read()).encode(text)).cast("I")) == _ids(text)


def test_encode_decode_of_awkward_rows(spark):
    docs = spark.createDataFrame(messy_rows(), SCHEMA)
    got = encode_decode(docs, PATH).collect()
    assert len(got) == docs.count()
    want = sorted((r.doc_id or -1, np.array(_ids(r.text), np.uint32).tobytes(), LIBRARY.decode(_ids(r.text), skip_special_tokens=False)) for r in docs.collect())
    assert sorted((r.doc_id or -1, bytes(r.ids), r.decoded) for r in got) == want
    assert encode_decode(docs.filter("false"), PATH).count() == 0


def _check_pieces(rows, texts, window):
    """Every id in exactly one piece, sequences without holes, lengths as promised."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    seen = []
    for (doc, tokens), pieces in by_doc.items():
        at, ids = 0, b""
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at, ids = at + r.length, ids + bytes(r.ids)
        assert at == tokens
        seen.append((doc, ids))
    assert sorted(seen) == sorted((d, np.array([*_ids(t), 2], np.uint32).tobytes()) for d, t in texts)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_packing_of_awkward_rows(spark):
    rows = [r for r in messy_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame(rows, SCHEMA)
    for shard, window in ((4_000, 64), (10**9, 4096)):
        _check_pieces(pack(docs, PATH, window=window, shard_bytes=shard).collect(), [(r[0], r[1]) for r in rows], window)
    assert pack(docs.filter("false"), PATH).count() == 0


def test_repeated_rows_and_null_keys_are_packed(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = pack(docs, PATH).collect()
    assert sum(r.length for r in got) == 3 + 3 + 2 + 1
    assert zlib.crc32(b"".join(sorted(bytes(r.ids) for r in got if r.doc_id == 2))) == zlib.crc32(np.array([2], np.uint32).tobytes())


def test_neighbours_by_bm25():
    docs = [np.array(x, np.uint32) for x in ([5, 6, 7, 2], [5, 6, 8, 2], [9, 9, 9, 2], [7, 1, 1, 2])]
    index = Bm25(docs)
    unused = np.array([False, True, True, True])
    found = index.neighbours(0, unused)
    n, length = 4, np.array([4.0, 4, 4, 4])

    def score(i):
        total = 0.0
        for t in {5, 6, 7, 2}:
            df = sum(t in d for d in docs)
            tf = (docs[i] == t).sum()
            total += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length[i] / length.mean()))
        return total

    assert found[:2] == sorted((1, 2, 3), key=lambda i: -score(i))[:2] and found[0] == 1


def _brute_scores(docs, seed, df=None, n=None, mean=None):
    """BM25 of every document for all terms of the seed, one at a time."""
    n, mean = n or len(docs), mean or np.mean([len(d) for d in docs])
    scores = []
    for d in docs:
        total = 0.0
        for t in set(docs[seed].tolist()):
            f = sum(t in x for x in docs) if df is None else df[t]
            tf = int((d == t).sum())
            total += np.log1p((n - f + 0.5) / (f + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        scores.append(total)
    return np.array(scores)


def test_windows_are_filled_by_all_terms_of_the_seed():
    r = np.random.default_rng(3)
    seed = np.append(np.arange(100, 160), 2)  # 61 terms
    docs = [seed, *(np.append(r.choice(np.arange(100, 160) if i % 2 else np.arange(160, 300), 8, replace=False), 2) for i in range(300))]
    docs = [d.astype(np.uint32) for d in docs]
    scores = _brute_scores(docs, 0)
    others = np.arange(1, len(docs))
    want = others[np.argsort(-scores[others], kind="stable")]
    got = Bm25(docs).neighbours(0, np.arange(len(docs)) > 0)
    assert len(got) == len(docs) - 1
    assert np.allclose(scores[got], scores[want])
    pieces = fill_windows(docs, 61 + 9 * 150)  # the seed and 150 neighbours
    placed = [p[0] for p in pieces if p[3] == 0]
    assert placed[0] == 0 and len(placed) == 151
    assert np.allclose(scores[placed[1:]], scores[want[:150]])


def test_weights_come_from_the_whole_corpus(spark):
    texts = [f"common alpha{i % 3} word{i % 7} rare{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [np.array([*_ids(t), 2], np.uint32) for t in texts]
    encoded = packing._encoded(docs.select(F.col("doc_id").alias("id"), "text"), packing.broadcast_vocabulary(spark, PATH), 2, np.uint16)
    corpus = packing._count(encoded.repartition(5), np.uint16)
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]))
    assert corpus.n == 60 and corpus.mean == np.mean([len(x) for x in ids]) and corpus.df.tolist() == df.tolist()
    part = ids[:6]  # a shard weighs its terms as the corpus does
    order = np.argsort(-_brute_scores(part, 0, df, 60, corpus.mean)[1:], kind="stable") + 1
    assert Bm25(part, corpus).neighbours(0, np.arange(6) > 0) == order.tolist()
    index = Bm25(part, corpus)
    got = np.bincount(index.owner, index.weight * np.isin(np.repeat(np.arange(len(index.at) - 1), np.diff(index.at)), ids[0]), 6)
    assert np.allclose(got, _brute_scores(part, 0, df, 60, corpus.mean))


def test_copies_share_windows():
    r = np.random.default_rng(0)
    groups = [r.integers(10, 5000, 30) for _ in range(20)]
    docs = [np.append(groups[i % 20], 2).astype(np.uint32) for i in range(60)]
    pieces = fill_windows(docs, 93)  # three copies of a group fill one window
    where = defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        where[doc % 20].add(sequence)
    assert np.mean([len(s) for s in where.values()]) < 1.5


def test_every_code_point_as_the_library():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 5000):
        text = "a".join(chars[i : i + 5000])
        assert list(memoryview(OWN.encode(text)).cast("I")) == _ids(text)
