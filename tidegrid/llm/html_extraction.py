"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, by kind; the weights are log odds counted over labelled
pages, those that mark their article themselves. One linear scan finds the contiguous region of the largest sum. Elements that never
hold an article (scripts, menus, forms, adverts, notices, reader comments ...) are taken out of the sequence before the scan.

The region's text is returned as blocks in page order: character references decoded, white space turned into single spaces.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED_PAGES = 400  # that weights are counted on at most: those with the smallest hash of their key
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Fixed values of HTML: elements without content, with raw content, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object audio video canvas xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody tfoot thead tr caption ul".split()
)
SPACED = frozenset("br td th option".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Elements that hold no article, by name, role, and parts of class or id.
APART = frozenset("head nav aside footer form button select menu dialog".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail footer comment comments reply replies respond disqus discussion related recommended "
    "recommendations share sharing social newsletter subscribe subscription signup login search widget widgets toolbar skip masthead topbar copyright legal disclaimer".split()
)
HEADS = frozenset("header".split())  # apart unless the article holds it
ARTICLE = frozenset("article main".split())
DEFAULT = {"word": 1.0, "word a": 0.2, "word li": 0.6, "word h": 1.0, "a": -0.5, "p": -0.2, "br": -0.1, "h": -0.2, "li": -0.3, "ul": -0.5, "ol": -0.5, "blockquote": -0.2, "div": -1.0} | dict.fromkeys(
    ("b", "i", "em", "strong", "span", "figure", "figcaption", "pre", "td", "tr", "section", "img"), -0.2
)
DEFAULT_TAG = -3.25


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _apart(tag: str, rest: str, inside: bool) -> bool:
    if tag in APART or (tag in HEADS and not inside):
        return True
    if not rest or "=" not in rest and "hidden" not in rest:
        return False
    a = _attributes(rest)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return tag not in ("html", "body")
    if tag in ARTICLE or tag in ("html", "body"):
        return False
    names = {n.lower() for n in _NAMES.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    return a.get("role", "").lower() in ROLES or bool(names & PARTS) or ("header" in names and not inside and tag not in ("h1", "h2", "h3"))


def events(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, text, apart, inside article) of each run of text ("#") and each tag in page order."""
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is apart
    depth = articles = at = 0

    def pop(to: int) -> None:
        nonlocal depth, articles
        for tag, apart in stack[to:]:
            depth -= apart
            articles -= tag in ARTICLE
        del stack[to:]

    def find(tag: str, scope: set | frozenset = frozenset()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                return i
            if stack[i][0] in scope:
                break
        return -1

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            yield "#", page[at:], depth > 0, articles > 0
            break
        if m.start() > at:
            yield "#", page[at : m.start()], depth > 0, articles > 0
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, rest = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            apart = depth > 0
            if (i := find(tag)) >= 0:
                pop(i)
            yield tag, "", apart, articles > 0
            continue
        if tag in ARTICLE and depth and not articles:  # an element left open does not swallow the article
            pop(next(i for i, x in enumerate(stack) if x[1]))
        if tag == "body" and (i := find("head")) >= 0:
            pop(i)
        if tag in BLOCKS and (i := find("p", BLOCKS - {"p"})) >= 0:
            pop(i)
        if tag in SIBLINGS:
            twins = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            found = max(find(t, SIBLINGS[tag]) for t in twins)
            if found >= 0:
                pop(found)
        apart = _apart(tag, rest, articles > 0)
        yield tag, "", depth > 0 or apart, articles > 0
        if tag in VOID or rest.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((tag, apart))
        depth += apart
        articles += tag in ARTICLE


class _Kinds:
    """Kind of each event for the weights: words by where they stand, tags by name."""

    def __init__(self) -> None:
        self.open: dict[str, int] = defaultdict(int)

    def of(self, kind: str) -> str:
        if kind != "#":
            return "h" if len(kind) == 2 and kind[0] == "h" and kind[1].isdigit() else kind if kind in BLOCKS or kind in SPACED or kind in ("a", "b", "i", "em", "strong", "span", "img", "input") else "other"
        return self.word

    word = "word"

    def step(self, kind: str, closing: bool) -> None:
        if kind in ("a", "li") or len(kind) == 2 and kind[0] == "h" and kind[1].isdigit():
            self.word = "word" if closing else "word " + ("h" if kind[0] == "h" else kind)


def _steps(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(weight kind, tag or "#", text, apart, inside) in page order; an element of interest ends at its own closing tag or a new block."""
    kinds, within = _Kinds(), ""
    for kind, text, apart, inside in events(page):
        yield kinds.of(kind), kind, text, apart, inside
        if kind == "#":
            continue
        if kind == within:
            kinds.step(kind, True)
            within = ""
        elif kind in BLOCKS or kind == "a":
            kinds.word = "word"
            kinds.step(kind, False)
            within = kind if kinds.word != "word" else ""


def label_counts(page: str) -> dict[str, list[int]]:
    """Tokens of each kind outside and inside the article that the page marks."""
    counts: dict[str, list[int]] = {}
    for kind, tag, text, apart, inside in _steps(page):
        many = len(text.split()) if tag == "#" else tag not in ARTICLE
        if many:
            counts.setdefault(kind, [0, 0])[inside and not apart] += many
    return counts


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds of being inside; words are held above zero and tags below."""
    out = sum(c[0] for c in counts.values())
    into = sum(c[1] for c in counts.values())
    if not out or not into:
        return dict(DEFAULT)
    odds = {k: math.log((c[1] + 0.5) / (c[0] + 0.5)) - math.log(into / out) for k, c in counts.items()}
    return {k: min(3.0, max(0.05, v)) if k.startswith("word") else max(DEFAULT_TAG, min(-0.02, v)) for k, v in odds.items()} | {"word": max(0.5, odds.get("word", 1.0))}


def learn_weights(pages: DataFrame, key: str = "page_id", text: str = "html", rows: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most ``rows`` pages with an article or main element; fixed ones if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[str, list[int]] = {}
            for page in b.column(0).to_pylist():
                for kind, (out, into) in label_counts(page).items():
                    both = total.setdefault(kind, [0, 0])
                    both[0] += out
                    both[1] += into
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in (0, 1))], ["kind", "out", "into"])

    marked = pages.filter(F.col(text).rlike(r"(?i)<(article|main)[\s>]")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    some = marked.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(rows)
    sums = marked.join(F.broadcast(some), "k").select("t").mapInArrow(run, "kind string, out long, into long").groupBy("kind").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return weights_of({r.kind: (r.out, r.into) for r in sums.collect()})


def main_blocks(page: str, weights: dict[str, float]) -> list[str]:
    """Blocks of the region with the largest sum, in page order."""
    best, best_span, run, start = 0.0, (0, -1), 0.0, 0
    pieces: list[tuple[int, str]] = []  # text at its place; None ends a block
    for i, (kind, tag, text, apart, _) in enumerate(_steps(page)):
        if tag == "#":
            if apart:
                continue
            pieces.append((i, text))
            many = len(text.split())
            score = many * weights.get(kind, weights.get("word", 1.0)) if many else 0.0
        else:
            if tag in BLOCKS:
                pieces.append((i, "\0"))
            elif tag in SPACED:
                pieces.append((i, " "))
            score = 0.0 if apart else weights.get(kind, DEFAULT.get(kind, DEFAULT_TAG))
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, best_span = run, (start, i)
    blocks, held = [], []
    for i, text in [*((i, t) for i, t in pieces if best_span[0] <= i <= best_span[1]), (0, "\0")]:
        if text == "\0":
            block = " ".join(html.unescape("".join(held)).split())
            if block:
                blocks.append(block)
            held = []
        else:
            held.append(text.replace("\0", ""))
    return blocks


def extract_main_text(pages: DataFrame, weights: dict[str, float], key: str = "page_id", text: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, ``keep`` ..., blocks, text) of every row: the blocks of the main text, and these joined by an empty line.

    A null or empty page, or one without words, has no blocks and an empty text. Repeated rows stay; other columns are not read.
    """
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [main_blocks(p, weights) if p else [] for p in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(blocks, pa.list_(pa.string())), pa.array(["\n\n".join(x) for x in blocks], pa.string())], [*names, "blocks", "text"])

    picked = pages.select(*names, F.col(text).cast("string").alias("__html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(names)])
    return picked.mapInArrow(run, f"{kinds}, blocks array<string>, text string")
