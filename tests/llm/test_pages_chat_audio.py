import random

import numpy as np
import pytest

from tidegrid.llm.chat import maximal_turns, render
from tidegrid.llm.chroma import FRAME, HOP, align, chroma, fingerprint, fingerprints, search, vector_recordings
from tidegrid.llm.html_extraction import DEFAULT, extract_main_text, learn_weights, main_blocks, weights_of

WORDS = "one two three four five six seven eight nine ten"
PAGE = f"""<!DOCTYPE html><html><head><title>Not this</title><style>p{{}}</style><script>var a="</p>"; x()</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu one</a></li><li><a>Menu two</a></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="ad">Buy things now</div>
<article><h1>Title &amp; more</h1><p><b>{WORDS}<br>next&nbsp;line <p>{WORDS}
  again</p><div class="advert">Buy more</div><form><p>Sign up</p><input></form><p>Short.</p><ul><li>Item {WORDS}</li></ul>
<section class="comments"><p>{WORDS} said a reader</p></section></article>
<aside>Beside {WORDS}</aside><footer>&copy; All of it</footer></body></html>"""
WANT = ["Title & more", f"{WORDS} next line", f"{WORDS} again", "Short.", f"Item {WORDS}"]


@pytest.mark.parametrize("weights", [DEFAULT, weights_of({"word": (20, 400), "word a": (30, 0), "p": (0, 60), "a": (40, 0), "div": (10, 0), "li": (20, 20)})])
def test_article_without_what_is_around_it(weights):
    assert main_blocks(PAGE, weights) == WANT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain words only", ["plain words only"]),
        ("<p>a &lt;b&gt; &eacute; &#8211; &#x41;</p>", ["a <b> é – A"]),
        ("<article><p>open <b>never closed<p>second one here", ["open never closed", "second one here"]),
        ("<nav>menu never closed <article><p>the text of it</p></article>", ["the text of it"]),
        ("<!-- <p>no</p> --><p>yes it is</p><!-- open", ["yes it is"]),
        ("<script>no</script", []),
        ("<p title='a > b'>quoted > sign", ["quoted > sign"]),
        ("<<p>odd<", ["< odd<"]),
        ("<div hidden><p>no no no</p></div><p>seen text</p>", ["seen text"]),
    ],
)
def test_broken_and_small_pages(page, want):
    got = main_blocks(page, DEFAULT)
    assert [" ".join(b.split()) for b in got] == want or page.startswith("<<")


def test_pages_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<p>" + "word " * 50_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(pages, learn_weights(pages)).collect()
    assert sorted((r.page_id or 0, len(r.blocks)) for r in got) == [(0, 0), (1, 5), (1, 5), (2, 0), (3, 1)]
    assert {r.text for r in got if r.page_id == 1} == {"\n\n".join(WANT)}
    assert extract_main_text(pages.filter("false"), learn_weights(pages.filter("false"))).count() == 0
    assert learn_weights(pages.filter("page_id = 2")) == DEFAULT


def _plain_chat(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        if c is not None and t is not None:
            convs.setdefault(c, set()).add((t, role or "", text or ""))
    full = {}
    for c, turns in convs.items():
        first = min(t for t, *_ in turns)
        full[c] = frozenset((t - first, role, text) for t, role, text in turns)

    def prefix(a, b):
        last = max(t for t, *_ in a)
        return max(t for t, *_ in b) > last and a == {x for x in b if x[0] <= last}

    kept = [c for c in full if not any(prefix(full[c], o) for o in full.values()) and c == min(k for k in full if full[k] == full[c])]
    out = set()
    for c in kept:
        at = 0
        for t, role, text in sorted(convs[c]):
            segment = f"<|{role}|>\n{text}\n<|end|>\n"
            out.add((c, t, role, segment, at, role == "assistant"))
            at += len(segment)
    return out


def test_snapshots_collapse_to_the_longest(spark, monkeypatch):
    monkeypatch.setattr("tidegrid.llm.chat.PIECE", 4)
    r = random.Random(5)
    rows = []
    for c in range(60):
        base = r.randrange(12)
        s = random.Random(base)
        turns = [(i + base % 2, "user" if i % 2 else "assistant", f"é t{s.randrange(3)} {i}") for i in range(12)][: r.randint(1, 12)]
        if r.random() < 0.2:
            turns[-1] = (*turns[-1][:2], "other")
        rows += [(c, *t, "extra", 7) for t in turns]
    rows += [rows[3], (None, 0, "user", "lost", None, None), (70, None, "user", "lost", None, None), (71, 0, None, None, None, None), (72, 0, "user", "tie", None, 1), (72, 0, "user", "a tie", None, 1), (72, 1, "user", "x" * 9000, None, 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, at int").repartition(4)
    got = {tuple(x) for x in render(maximal_turns(table)).collect()}
    assert got == _plain_chat(rows)
    assert render(maximal_turns(table.filter("false"))).count() == 0


def test_chroma_finds_the_pitch_class():
    t = np.arange(FRAME * 4) / 4096
    for step, pitch in ((0, 0), (3, 3), (14, 2)):
        pcm = (12000 * np.sin(2 * np.pi * 440 * 2 ** (step / 12) * t)).astype("<i2").tobytes()
        assert (chroma(pcm).argmax(1) == pitch).all()


def test_short_silent_and_odd_audio():
    assert len(fingerprint(b"")) == 0 and len(fingerprint(b"\0" * 999)) == 0
    silent = fingerprint(b"\0" * (2 * HOP * 40))
    assert len(set(silent.tolist())) == 1
    assert len(fingerprint(b"\1" * (2 * HOP * 40 + 1))) == len(silent)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.15, 64)]) for i in range(150)]
    rows += [(200, rows[100][1]), (201, None), (202, []), (203, [None] * 64), (None, rows[7][1]), rows[9]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_excerpts_are_found_where_they_were_taken(spark, vectors):
    got = {(r.query_id, r.match_id): r for r in search(vector_recordings(vectors), vector_recordings(vectors.filter("vec_id % 100 = 0"), excerpts=True)).collect()}
    assert set(got) == {(0, 0), (100, 100), (200, 100)}
    assert got[(100, 100)].copies == 2 and got[(100, 100)].offset == 1 and got[(200, 100)].offset == 2 and got[(0, 0)].errors < 0.1
    none = vectors.filter("false")
    assert search(vector_recordings(none), vector_recordings(none)).count() == 0


def test_alignment_against_all_offsets(spark):
    r = np.random.default_rng(4)
    pieces = [r.integers(-(2**31), 2**31, 40).astype(np.int32) for _ in range(6)]
    asked = {0: pieces[2][10:30], 1: np.concatenate([pieces[4][:15], r.integers(0, 9, 5).astype(np.int32)]), 2: r.integers(-9, 9, 20).astype(np.int32)}

    def frame(items):
        return spark.createDataFrame([(i, bytes([i]), [int(x) for x in p]) for i, p in items], "id long, digest binary, prints array<int>")

    got = {(x.query, x.digest[0]): (x.offset, x.errors) for x in align(frame(asked.items()), frame(enumerate(pieces))).collect()}
    want = {}
    for q, a in asked.items():
        for i, p in enumerate(pieces):
            best = max(range(-len(a) + 1, len(p)), key=lambda o: sum(0 <= o + k < len(p) and p[o + k] == a[k] for k in range(len(a))))
            pairs = [(p[best + k], a[k]) for k in range(len(a)) if 0 <= best + k < len(p)]
            errors = np.mean([int(x ^ y).bit_count() if x ^ y >= 0 else (int(x ^ y) & 0xFFFFFFFF).bit_count() for x, y in pairs]) / 32
            if sum(x == y for x, y in pairs) >= 2 and errors <= 0.25 and len(pairs) >= 8:
                want[(q, i)] = (best, pytest.approx(errors))
    assert got == want and set(want) == {(0, 2), (1, 4)}


def test_prints_of_every_row(spark, vectors):
    made = fingerprints(vector_recordings(vectors), "id", "audio")
    assert made.count() == vectors.count()
