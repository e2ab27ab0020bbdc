import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import SCHEMA, messy_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, decoders

from pyspark.sql import functions as F

from tidegrid.llm.queries import op13_token_alignment
from tidegrid.llm.token_alignment import Aligner, align_tokenizers, byte_level_table, cut_pattern, piece_table, terminals

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
A.encode_special_tokens = True
WHOLE = Aligner(byte_level_table(BYTES), piece_table(PIECES))
OWN = Aligner(byte_level_table(BYTES), piece_table(PIECES), cut_pattern(BYTES, PIECES))
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = dict(zip([chr(b) for b in _SHOWN] + [chr(256 + i) for i in range(68)], _SHOWN + [b for b in range(256) if b not in _SHOWN], strict=True))


def _plain(text):
    """(ids of A, ids of B, groups, links) of one text, byte by byte; None where bytes differ."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw_a = [bytes(_LETTER[c] for c in A.id_to_token(i)) for i in a]
    raw_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    of_a = [k for k, x in enumerate(raw_a) for _ in x]
    of_b = [k for k, x in enumerate(raw_b) for _ in x]
    links = sorted(set(zip(of_a, of_b, strict=True)))
    groups, start_a, start_b = [], 0, 0
    for at in range(len(of_a)):
        end = at + 1 == len(of_a) or (of_a[at] != of_a[at + 1] and of_b[at] != of_b[at + 1])
        if end:
            groups.append((a[start_a : of_a[at] + 1], b[start_b : of_b[at] + 1]))
            start_a, start_b = of_a[at] + 1, of_b[at] + 1
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def _rows(texts):
    done = [_plain(t) for t in texts]
    counts = Counter(p for d in done if d for p in d[3])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for d in done:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


AWKWARD = ["a", " ", "  two  spaces ", "\t\n\r", "<s></s><unk><|endoftext|>", "é" * 50, "日本語のテキスト 😀👍🏽", "▁under", "x▁y", "\x00\x01", "<0x41>", "İ ǅ ﬁ ½", "a" * 3000, "½²³ Ⅷ", "﻿bom", " nb"]


@pytest.mark.parametrize("text", AWKWARD)
def test_corner_cases(text):
    want = _rows([text])[0]
    for aligner in (OWN, WHOLE):
        got = aligner.block([text.encode()])[0]
        assert (*got[:4], got[4]) == (*want[:4], want[6])


SPACED = st.lists(st.sampled_from(list(" \t\n\x1c\x85\u00a0\u3000\u200b'.,aBé1½中▁") + ["'s", "th", " the", "  ", "🏽", "<s>"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=40) | SPACED, max_size=6))
def test_blocks_of_any_texts(texts):
    got = OWN.block([t.encode() for t in texts])
    assert [(*g[:4], g[4]) for g in got] == [(*w[:4], w[6]) for w in _rows(texts)]
    for g, t in zip(got, texts, strict=True):
        plain = _plain(t)
        pairs = Counter(a * OWN.width + b for a, b in plain[3]) if plain else {}
        assert dict(zip(g[5].tolist(), g[6].tolist(), strict=True)) == dict(pairs)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60).flatmap(lambda n: st.tuples(*[st.sets(st.integers(1, n), max_size=n).map(lambda s, n=n: sorted(s | {n}))] * 2)))
def test_terminals_end_where_both_sides_end(ends):
    ends_a, ends_b = (np.array(x) for x in ends)
    to = terminals(ends_a, ends_b)
    common = np.intersect1d(ends_a, ends_b)
    want = [int(np.searchsorted(ends_a, common[np.searchsorted(common, e)])) for e in (*ends_a, *ends_b)]
    assert to.tolist() == want


def test_byte_table_is_the_decoder_of_the_library():
    table = byte_level_table(BYTES)[1]
    decoder = decoders.ByteLevel()
    for i in range(0, 50_000, 97):
        assert decoder.decode([A.id_to_token(i)]) == table[i].decode(errors="replace")


@pytest.mark.parametrize("head", [1 << 16, 20])
def test_alignment_of_awkward_rows(spark, monkeypatch, head):
    monkeypatch.setattr("tidegrid.llm.token_alignment.MEMO", head)
    rows = messy_rows(many=40) + [(10_000 + i, t, *[None] * 7) for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("pairs", F.lit("x")).withColumn("row", F.lit(1)).repartition(5)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align_tokenizers(docs, BYTES, PIECES, head=head).collect())
    assert got == sorted((r[0] if r[0] is not None else -1, *w) for r, w in zip(rows, _rows([r[1] for r in rows]), strict=True))
    assert align_tokenizers(docs.filter("false"), BYTES, PIECES).count() == 0


def test_query_13(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    got = {r.doc_id: r for r in op13_token_alignment(spark, path).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, _rows([d.text for d in docs]), strict=True):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w
