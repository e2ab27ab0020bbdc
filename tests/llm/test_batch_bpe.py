"""Ids of whole batches, and windows filled from a shrinking index, next to plain versions."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegrid.llm import batch_bpe, lexical_packing, shingles
from tidegrid.llm.batch_bpe import BatchBpe, ragged
from tidegrid.llm.lexical_packing import Bm25, fill_windows

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, "rb").read()
LIBRARY = Tokenizer.from_file(PATH)
OWN = BatchBpe(SPEC)


def _split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def _same(bpe, texts):
    ids, counts, hashes, runs = bpe.encode([t.encode() for t in texts])
    assert len(hashes) == runs.sum()
    assert _split(ids, counts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_any_batch_as_the_library(texts):
    _same(OWN, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abtheinr 'sS<|>Éé̈\n", max_size=80), min_size=1, max_size=4))
def test_batches_of_mergeable_words(texts):
    _same(OWN, texts)


def test_corner_cases():
    _same(OWN, ["", "   ", "x<|startoftext|>y <|endoftext|> <|ENDOFTEXT|>", "ΑΣ ΟΣ", "it's DON'T", "１２ ½", "a\x1cb\x85c​d", "İstanbul", "ab" * 3000, "é" * 40, "the The THE", "　a"])
    _same(OWN, [""])


def test_memo_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(batch_bpe, "MEMO", 6)
    bpe = BatchBpe(SPEC)
    for i in range(20):
        _same(bpe, ["the and the and", f"word{i} other{i} the", "<b> the"])
        assert len(bpe.known) <= 6 + 5


def test_every_code_point_in_a_batch():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    _same(OWN, ["a".join(chars[i : i + 20000]) for i in range(0, len(chars), 20000)])
    _same(OWN, [" ".join(chars[i : i + 20000]) for i in range(0, len(chars), 20000)])


def test_ragged():
    flat = np.arange(10)
    assert ragged(flat, np.array([7, 0, 3]), np.array([2, 0, 3])).tolist() == [7, 8, 3, 4, 5]
    assert not len(ragged(flat, np.zeros(0, np.int64), np.zeros(0, np.int64)))


def _plain_windows(docs, window):
    """The document order of the packing, every seed scored against all documents."""
    index = Bm25(docs)
    weights = np.zeros((int(max(map(max, docs))) + 1, len(docs)))
    for t in range(len(weights)):
        part = slice(index.at[t], index.at[t + 1])
        weights[t, index.owner[part]] = index.weight[part]
    unused, order, filled, queue = [True] * len(docs), [], 0, []
    while any(unused):
        queue = [d for d in queue if unused[d]]
        seed = not queue
        doc = unused.index(True) if seed else queue[0]
        unused[doc] = False
        order.append(doc)
        closed, filled = filled + len(docs[doc]) >= window, (filled + len(docs[doc])) % window
        if closed and not filled:
            queue = []
        elif closed or seed:
            score = weights[np.unique(docs[doc])].sum(0)
            queue = [d for d in sorted(range(len(docs)), key=lambda d: (-round(score[d], 9), d)) if score[d] > 0]
    return order


def test_windows_from_a_shrinking_index():
    r = np.random.default_rng(5)
    docs = [np.append(r.choice(400, int(r.integers(1, 60)), p=None), 401 if i % 3 else 402).astype(np.uint32) for i in range(300)]
    got = []
    for doc, start, *_ in fill_windows(docs, 128):
        if start == 0 and doc not in got:
            got.append(doc)
    assert got == _plain_windows(docs, 128)


def test_ranking_is_whole_and_ordered_after_dropping():
    r = np.random.default_rng(6)
    docs = [np.append(r.integers(0, 50, 12), 60).astype(np.uint32) for _ in range(500)]
    unused = r.random(500) < 0.4
    unused[0] = False
    index = Bm25(docs)
    before = index.neighbours(0, unused)
    index.drop(unused)
    assert index.neighbours(0, unused) == before and sorted(before) == np.flatnonzero(unused).tolist()


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_terms_of_many_documents_are_counted_in_blocks(kind, monkeypatch):
    r = np.random.default_rng(2)
    docs = [r.integers(0, np.iinfo(kind).max, n, kind, endpoint=True)[r.integers(0, n, 2 * n)] for n in (1, 40, 300, 1, 7, 90)]
    docs[3][:] = np.iinfo(kind).max
    want = [np.unique(d, return_counts=True) for d in docs]
    for tokens in (1, 100, 10**6):
        monkeypatch.setattr(lexical_packing, "TOKENS", tokens)
        blocks = list(lexical_packing.distinct(docs))
        assert tokens > 1 or len(blocks) == len(docs)
        assert tokens < 10**6 or len(blocks) == 1
        terms, counts, sizes = (np.concatenate(x) for x in zip(*blocks))
        assert terms.dtype == kind and sizes.tolist() == [len(t) for t, _ in want]
        assert terms.tolist() == np.concatenate([t for t, _ in want]).tolist() and counts.tolist() == np.concatenate([c for _, c in want]).tolist()


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    raw = np.frombuffer(b" ab  c\n" + b"x" * 900 + b" d\te " * 50 + b"\n", np.uint8)
    whole = shingles.buffer_hashes(raw)
    assert [bytes(raw[a:b]) for a, b in zip(*whole[:2])] == bytes(raw).split()
    for size in (1, 5, 64, 700):
        monkeypatch.setattr(shingles, "_PIECE", size)
        monkeypatch.setattr(shingles, "_powers", [])
        assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.buffer_hashes(raw)))


def test_ranks_of_bytes_are_looked_up_in_a_table():
    bpe = BatchBpe(SPEC)
    for last, table in zip((bpe.inner, bpe.last), bpe.first):
        assert np.array_equal(table.reshape(256, 256), bpe._rank(bpe.inner[:, None] + 0 * last, last[None] + 0 * bpe.inner[:, None]))
