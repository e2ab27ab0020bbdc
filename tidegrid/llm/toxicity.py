"""Toxicity: boosted trees over dense features of the text, with isotonic calibration.

Features: densities of a lexicon, its nearness to second-person words, capitals, punctuation, obfuscated words. The lexicon
(words and word beginnings that labelled toxic texts use far more often than others) is counted by Spark over the labelled sample; the
sample is bounded by ``supervised.SAMPLE_ROWS``, so its feature rows are fitted on the driver. Scoring is one pass over the documents, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidegrid.llm.boosting import Trees, fit_trees, isotonic
from tidegrid.llm.store import byte_texts, with_text_column
from tidegrid.llm.supervised import SAMPLE_ROWS, byte_profile, labelled_sample, share

LEXICON_TERMS = 2_000
LEAST_TEXTS = 4  # toxic texts that must use a term
LEAST_Z = 3.0  # of its log odds
STEMS = (4, 5, 6, 7)  # lengths of word beginnings
NEAR = 5  # words
MEMO = 200_000
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_RUN = re.compile(r"(.)\1{3,}")
FEATURES = 17


def plain_word(word: str) -> str:
    """Lower case, without symbols at its ends; digits and symbols that stand for letters inside a word are read as these."""
    w = _EDGE.sub("", word.lower())
    return w.translate(_LEET) if not w.isalpha() and any(c.isalpha() for c in w) else w


def terms_of(word: str) -> list[str]:
    """The word and, marked by a star, its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)] if len(word) > 1 else []


class _Words(dict):
    """Weight and flags of words as they stand in texts, kept while a worker meets them again."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {term.rstrip("*")[:2] for term in lexicon}

    def __missing__(self, word: str) -> tuple[float, int, str]:
        plain = word.isalpha()
        w = word.lower() if plain else plain_word(word)
        weight = max((self.lexicon.get(t, 0.0) for t in terms_of(w)), default=0.0) if w[:2] in self.heads else 0.0
        odd = False
        if not plain:
            inner = _EDGE.sub("", word).replace("'", "").replace("-", "")
            odd = not inner.isalpha() and any(c.isalpha() for c in inner)
        flags = (w in SECOND_PERSON) | 2 * (len(word) > 1 and word.isupper()) | 4 * odd | 8 * (_RUN.search(word) is not None)
        if len(self) > MEMO:
            self.clear()
        self[word] = out = (weight, int(flags), w)
        return out


def features_of(texts: list[bytes], known: _Words) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES))
    for row, raw in zip(out, texts):
        words = raw.decode("utf-8", "replace").split()
        n = len(words)
        info = [known[w] for w in words]
        marked = [(i, x[1]) for i, x in enumerate(info) if x[0] or x[1]]
        hits = [i for i, _ in marked if info[i][0]]
        flags = [f for _, f in marked]
        you = [i for i, f in marked if f & 1]
        near = sum(any(abs(i - j) <= NEAR for j in you) for i in hits) if you else 0
        weights = [info[i][0] for i in hits]
        chars = byte_profile(raw)
        letters = int(chars[65:91].sum() + chars[97:123].sum() + chars[128:].sum())
        row[:] = (
            math.log1p(n),
            share(len(hits), n),
            share(sum(weights), n),
            math.log1p(len(hits)),
            max(weights, default=0.0),
            share(sum(weights), math.sqrt(n)),
            math.log1p(len({info[i][2] for i in hits})),
            share(len(you), n),
            share(near, n),
            share(int(chars[65:91].sum()), letters),
            share(sum(f >> 1 & 1 for f in flags), n),
            share(int(chars[33]), n),
            share(int(chars[63]), n),
            share(int(chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum()), len(raw)),
            share(sum(f >> 2 & 1 for f in flags), n),
            share(sum(f >> 3 & 1 for f in flags), n),
            share(len(raw), n),
        )
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.trees.raw(x), self.knots, self.values), 0.0, 1.0)


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], ...]:
    """Log odds of the terms that mark toxic texts, from document counts of the sample.

    Also as a text of the sample that isn't toxic, or is, would see them if it had not been counted itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for raw, y in zip(byte_texts(b.column(0)), b.column(1).to_pylist()):
                words = {plain_word(w) for w in set(raw.decode("utf-8", "replace").split())}
                for term in {t for w in words for t in terms_of(w)}:
                    seen.setdefault(term, [0, 0])[1 if y else 0] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["term", "other", "toxic"]
            )

    many = sample.agg(F.sum(F.lit(1) - F.col("y")), F.sum("y")).first()
    other, toxic = many[0] or 0, many[1] or 0
    if not other or not toxic:
        return {}, {}, {}
    p = (F.col("toxic") + 0.5) / (toxic - F.col("toxic") + 0.5)
    q = (F.col("other") + 0.5) / (other - F.col("other") + 0.5)
    odds = F.log(p / q)
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    sums = sample.mapInArrow(count, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    best = sums.filter(F.col("toxic") >= LEAST_TEXTS).select("term", "toxic", "other", z.alias("z")).filter(F.col("z") >= LEAST_Z)
    rows = best.orderBy(F.desc("z"), "term").limit(LEXICON_TERMS).collect()

    def weights(less_toxic: int, less_other: int) -> dict[str, float]:
        found = {}
        for r in rows:
            a, b = r.toxic - less_toxic, r.other - less_other
            odds = math.log((a + 0.5) / (toxic - r.toxic + 0.5)) - math.log((max(b, 0) + 0.5) / (other - r.other + 0.5))
            if a >= LEAST_TEXTS and odds / math.sqrt(1 / (a + 0.5) + 1 / (max(b, 0) + 0.5)) >= LEAST_Z:
                found[r.term] = odds
        return found

    return weights(0, 0), weights(0, 1), weights(1, 0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Model fitted on at most ``rows`` labelled documents for which ``train`` (over ``labels``) holds.

    Without labels of both kinds the score is the share of toxic labels, 0 if there are none. The calibration uses scores of trees that did
    not see the row.
    """
    sample = labelled_sample(docs, labels, label, train, key, text, rows).persist()
    lexicon, *without = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Words(w) for w in without]
        for b in batches:
            x = np.concatenate([features_of([t], known[y > 0]) for t, y in zip(byte_texts(b.column(0)), b.column(1).to_pylist())]) if b.num_rows else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows_ = sample.mapInArrow(run, "x array<double>, y int").collect()
    sample.unpersist()
    y = np.array([r.y > 0 for r in rows_], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(lexicon, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    x = np.array([r.x for r in rows_])
    order = np.lexsort((*x.T, y))  # independent of the order in which rows arrive
    x, y = x[order], y[order]
    fold = np.arange(len(y)) % 4
    apart = np.zeros(len(y))
    for k in range(4):
        inside = fold != k
        apart[~inside] = fit_trees(x[inside], y[inside]).raw(x[~inside])
    return ToxicityModel(lexicon, fit_trees(x, y), *isotonic(apart, y))


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; null texts score as empty ones. All rows and columns stay as they are."""

    def make():
        known = _Words(model.lexicon)
        return lambda texts: model.score(features_of(texts, known))

    return with_text_column(docs, text, name, DoubleType(), make)
