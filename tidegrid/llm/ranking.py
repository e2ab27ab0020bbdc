"""Quality by Bradley-Terry ranking: a linear score of document features learned from preference pairs.

A pair is a good and a bad labelled document; the logistic loss on the difference of their features makes the good
one score higher. The scores are then cut at a quantile of the labelled scores, the share of bad documents. All labelled documents take part:
they are dealt to blocks by a hash, pairs are formed inside a block, and each Newton step sums the blocks' gradients and curvatures. Scoring is one
pass over the documents, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidegrid.functions.quantiles import sorted_quantiles
from tidegrid.llm.store import byte_texts, frugal, store, with_text_column
from tidegrid.llm.supervised import byte_profile, known_labels, share

BLOCK_ROWS = 12_000  # labelled documents of a block of pairs
PAIRS = 40_000  # pairs of a block at least
RARE = 50  # documents of the rarer kind that a block has on average at least, if there are so many
RIDGE = 1e-3
STEPS = 25
CUT = 0.7  # score of a document at the quantile
RATES = 18


def rates_of(raw: bytes) -> list[float]:
    """Shares of characters, words and lines by which noise differs from prose; all 0 for an empty text."""
    words = raw.split()
    n, size, chars = len(words), len(raw), byte_profile(raw)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = int(chars[65:91].sum() + chars[97:123].sum() + chars[128:].sum())
    again = sum(a == b for a, b in zip(words, words[1:]))
    caps = bare = marked = 0
    for w, k in seen.items():
        if w.isalpha() and len(w) > 1 and w.isupper():
            caps += k
        elif not w[-1:].isalnum() and w[-1] < 128:
            if w.strip(b"!#$%&*+/<=>@\\^_`{|}~.,;:?-") == b"":
                bare += k
            elif w[-1] in b"#$%&*@^~|" or w[-2:] == b"!!":
                marked += k
            if len(w) > 3 and w[:-2].rstrip(b"!.,").isupper():
                caps += k
    return [
        share(caps, n),
        share(bare, n),
        share(marked, n),
        share(again, n),
        share(seen.most_common(1)[0][1] if seen else 0, n),
        1 - share(len(seen), n) if n else 0.0,
        share(int(chars[65:91].sum()), letters),
        share(int(chars[48:58].sum()), size),
        share(int(chars[33]), n),
        share(int(chars[35:39].sum() + chars[42] + chars[64]), n),
        share(int(chars[124]), n),
        share(int(chars[44] + chars[46]), n),
        1 - share(letters, size) if size else 0.0,
        share(int(chars[60] + chars[62] + chars[123] + chars[125] + chars[59] + chars[61]), size),
        share(len(lines) - len(set(lines)), len(lines)),
        share(len(lines), n),
        min(1.0, share(size, n) / 40),
        1 / (1 + math.log1p(n)) if n else 1.0,
    ]


def features_of(texts: list[bytes]) -> np.ndarray:
    """Rates, each as a root and as a curve that rises early."""
    x = np.array([rates_of(t) for t in texts]).reshape(len(texts), RATES)
    return np.hstack([np.sqrt(x), x / (x + 0.03)])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip(self.raw(x) - self.cut, -30, 30) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def paired(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """Differences of pairs drawn with a fixed seed, each row at least once."""
    draw = np.random.default_rng(7)
    many = max(pairs, len(good), len(bad))
    i = np.concatenate([np.arange(len(good)), draw.integers(0, len(good), many - len(good))])
    j = np.concatenate([draw.permutation(len(bad)), draw.integers(0, len(bad), many - len(bad))])
    return good[i] - bad[j]


def slopes(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over pairs of the gradient and the curvature of log(1 + exp(-w d)), and how many there are."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return d.T @ p, (d * (p * (1 - p))[:, None]).T @ d, len(d)


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]], size: int) -> np.ndarray:
    """Weights by Newton steps; ``sums`` gives the :func:`slopes` of all pairs."""
    w = np.zeros(size)
    for _ in range(STEPS):
        grad, curve, many = sums(w)
        step = np.linalg.solve(curve / many + RIDGE * np.eye(size), grad / many - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """Weights by Newton steps on log(1 + exp(-w (good - bad))) over pairs drawn with a fixed seed, each row at least once."""
    d = paired(good, bad, pairs)
    return newton(lambda w: slopes(d, w), d.shape[1])


def _labelled_features(docs: DataFrame, labels: DataFrame, train: Column, key: str, text: str, label: str) -> DataFrame:
    """(id, x, y) of every labelled document, one row per key: of several texts the one of the least hash. Texts are not exchanged, only features are."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features_of(byte_texts(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 2 * RATES).cast(pa.list_(pa.float64()))], ["id", "h", "x"])

    known = known_labels(labels, label, train, key)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).filter("id is not null")
    one = rows.mapInArrow(run, "id long, h long, x array<double>").join(known, F.col("id") == F.col("__id"))
    return one.groupBy("id").agg(F.min_by(F.struct("x", "y"), F.struct("h", "x")).alias("s")).select("id", "s.x", "s.y")


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = BLOCK_ROWS) -> QualityModel:
    """Model fitted on all labelled documents for which ``train`` (over ``labels``) holds, in blocks of about ``rows``.

    Without labels of both kinds there are no pairs: every document scores the share of good labels, 1 if there are none.
    """
    known, _ = store(_labelled_features(docs, labels, train, key, text, label), "labelled")
    n, good = known.agg(F.count("*"), F.count_if(F.col("y") > 0)).first()
    if not 0 < good < n:
        return QualityModel(np.zeros(1), np.ones(1), np.zeros(1), 0.0, good / n if n else 1.0)
    count = -(-n // rows)
    # rows of the rarer kind go to several blocks if need be, so that each block has some; statistics count them once
    copies = min(count, -(-RARE * count // min(good, n - good)))
    rare = (F.col("y") > 0) == F.lit(2 * good < n)
    dealt = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(rare, copies - 1).otherwise(0))))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id") + F.col("copy"), F.lit(count)))

    def pack(part: pa.Table) -> pa.Table:
        x, y = np.array(part["x"].to_pylist()), part["y"].to_numpy() > 0
        own = part["copy"].to_numpy() == 0
        order = np.lexsort((*x.T, y, ~own))  # independent of the order in which rows arrive
        x, y, own = x[order], y[order], int(own.sum())
        return pa.table({"x": [x.tobytes()], "y": [y.tobytes()], "own": [own], "n": [len(x)]})

    blocks, _ = store(dealt.groupBy("block").applyInArrow(pack, "x binary, y binary, own long, n long"), "blocks")

    def over(run: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        """Sums over all blocks of what ``run`` makes of one; a task hands on one row."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for raw, kind, own in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                    x, y = np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, 2 * RATES), np.frombuffer(kind.as_buffer(), bool)
                    found = run(x, y, own)
                    total = list(found) if total is None else [a + v for a, v in zip(total, found)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([[np.ravel(v).astype(float).tolist() for v in total]], pa.list_(pa.list_(pa.float64())))], ["v"])

        made = [r.v for r in blocks.mapInArrow(sums, "v array<array<double>>").collect()]
        return [np.sum([np.array(r[i]) for r in made], axis=0) for i in range(len(made[0]))]

    mean = over(lambda x, _, own: (x[:own].sum(axis=0),))[0] / n
    spread = over(lambda x, _, own: (np.square(x[:own] - mean).sum(axis=0),))[0] / n
    model = QualityModel(mean, np.maximum(np.sqrt(spread), 1e-6), np.zeros(2 * RATES), 0.0)

    def step(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        def run(x: np.ndarray, y: np.ndarray, _: int) -> tuple[np.ndarray, ...]:
            if y.all() or not y.any():
                return np.zeros(len(w)), np.zeros((len(w), len(w))), 0
            z = (x - model.mean) / model.scale
            return slopes(paired(z[y], z[~y]), w)

        grad, curve, many = over(run)
        return grad, curve.reshape(len(w), len(w)), many[0]

    model.weights = newton(step, 2 * RATES)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, own in zip(b.column(0), b.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, 2 * RATES)[:own]))], ["s"])

    # the quantile at the share of bad documents, half way between two scores
    bad = n - good
    model.cut = float(sorted_quantiles(blocks.mapInArrow(scores, "s double"), [], "s", [(bad - 0.5) / (n - 1)]).first()["quantile"])
    return model


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; null texts score as empty ones. All rows and columns stay as they are."""

    def make():
        return lambda texts: model.score(features_of(texts))

    return with_text_column(docs, text, name, DoubleType(), make)
