"""Masked pseudo-likelihood: a window network predicts each token from the tokens on both sides of it.

Tokens are words: the most frequent ones of all documents are types of their own, the others fall into hashed types. Each of the places around a
masked token has its own embedding table; their sum goes through tanh to a softmax over the types. Training is data parallel: in each
round every task improves the network on its part of a share of the documents, and Spark averages the parameters by the
number of tokens. The shares of all rounds are the whole corpus. What reaches the driver is one network, whatever the size of the corpus. A document's score is the sum of
the log probabilities of its tokens: of the type by the network and, where words share a type, of the word among those of its type by their counts, which
stay in a table that grows with the corpus. The counts of frequent words, a bounded number, go to every task; only rarer words are joined with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shingles import word_hashes
from tidegrid.llm.store import byte_texts, chunks, mix, store

KNOWN = 224  # types that are words
HASHED = 32  # types that other words share
TYPES = KNOWN + HASHED
PAD = TYPES  # beyond the ends of a document
SIDE = 3  # tokens on each side
WIDTH = 16
OFFSETS = (*range(-SIDE, 0), *range(1, SIDE + 1))
_AROUND = np.array(OFFSETS)[:, None]
_PLACES = np.arange(len(OFFSETS))[:, None] * (TYPES + 1)  # first row of each place in the embedding tables, one below the other
_PAIRS = np.arange(len(OFFSETS) * (TYPES + 1) * WIDTH // 2).reshape(-1, WIDTH // 2)  # numbers of the pairs of numbers in each of those rows
ROUNDS = SHARE = 4  # a round trains on one of so many documents, and each document is in one round
BATCH = 256
STEP = 0.08
BLOCK = 1024  # tokens that are scored at once, so that their scores of all types stay in a cache
REACH = 50  # scores between its negative and itself need no maximum: their exponentials are far from the limits of 32-bit floats
OFTEN = 1 << 16  # words, at most, whose counts every task has


@dataclass
class Window:
    embed: np.ndarray  # places x (types + 1) x width
    head: np.ndarray  # weights of the hidden values, and the bias below them: (width + 1) x types

    @property
    def out(self) -> np.ndarray:
        return self.head[:-1]

    @property
    def bias(self) -> np.ndarray:
        return self.head[-1]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.head.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Window:
        a = len(OFFSETS) * (TYPES + 1) * WIDTH
        flat = flat.astype(np.float32)
        return cls(flat[:a].reshape(len(OFFSETS), TYPES + 1, WIDTH).copy(), flat[a:].reshape(WIDTH + 1, TYPES).copy())

    def rows(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of the embedding tables, one below the other, for the places around each of ``at``; places x tokens."""
        return ids.take(at + _AROUND) + _PLACES

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        total = np.add.reduce(self.embed.reshape(-1, WIDTH).take(rows, axis=0), axis=0)
        return np.tanh(total, out=total)

    def scores(self, h: np.ndarray) -> np.ndarray:
        """Scores of all types, from hidden values with a one behind them; less the largest of a token where exponentials could over- or underflow."""
        z = h @ self.head
        if not (z.max() <= REACH and z.min() >= -REACH):
            z -= z.max(1, keepdims=True)
        return z

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the tokens at the places ``at`` of the padded sequence ``ids``."""
        found = np.empty(len(at), np.float32)
        for lo in range(0, len(at), BLOCK):
            p = at[lo : lo + BLOCK]
            z = self.scores(_with_one(self.hidden(self.rows(ids, p))))
            own = z[np.arange(len(p)), ids[p]]
            found[lo : lo + BLOCK] = own - np.log(_sums(np.exp(z, out=z)))
        return found


def _with_one(h: np.ndarray) -> np.ndarray:
    """Each row with a one behind it, which brings in the bias."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _sums(z: np.ndarray) -> np.ndarray:
    """Sum of each row; as a product it takes a third of the time of ``z.sum(1)``."""
    return z @ np.ones(z.shape[1], z.dtype)


def new_window(frequency: np.ndarray) -> Window:
    draw = np.random.default_rng(5)
    shape = (len(OFFSETS), TYPES + 1, WIDTH)
    embed, out = draw.normal(0, 0.1, shape), draw.normal(0, 0.1, (WIDTH, TYPES))
    return Window(embed.astype(np.float32), np.vstack([out, np.log((frequency + 1) / (frequency + 1).sum())]).astype(np.float32))


class Trainer:
    """Stochastic gradient steps, scaled per parameter by the gradients so far."""

    def __init__(self, net: Window):
        self.net = net
        self.seen = [np.full_like(x, 1e-4) for x in (net.embed, net.head)]
        self.embed = np.empty_like(net.embed)  # gradient of a step

    def step(self, ids: np.ndarray, at: np.ndarray) -> None:
        net, n = self.net, len(at)
        rows = net.rows(ids, at)
        h = net.hidden(rows)
        one = _with_one(h)
        z = net.scores(one)
        np.exp(z, out=z)
        total = _sums(z)
        # probabilities less one at the own type, times the total: not this large matrix is divided, but what it is multiplied by
        z[np.arange(n), ids[at]] -= total
        scale = 1 / (total * n)[:, None]
        one *= scale
        back = z @ net.out.T
        back *= 1 - h * h
        back *= scale
        # numpy adds up by single numbers several times faster than by rows, in the same order; a complex number is a pair of them
        self.embed.fill(0)
        pairs = np.empty((len(OFFSETS), back.size // 2), np.complex64)
        pairs[:] = back.view(np.complex64).ravel()
        np.add.at(self.embed.reshape(-1).view(np.complex64), _PAIRS.take(rows, axis=0).ravel(), pairs.ravel())
        for x, g, s in zip((net.embed, net.head), (self.embed, one.T @ z), self.seen):
            square = g * g
            s += square
            g *= STEP
            g /= np.sqrt(s, out=square)
            x -= g


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes of the known words
    types: np.ndarray  # their types
    counts: str = ""  # path of the table of all words and how often each occurs
    often: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of frequent words
    often_n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # how often each of them occurs

    def ids(self, h: np.ndarray) -> np.ndarray:
        hashed = (KNOWN + h % np.uint64(HASHED)).astype(np.int64)
        if not len(self.words):
            return hashed
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.types[at], hashed)

    def padded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Types of all words, with padding around each text; the places of the words; the number of words of each text."""
        h, counts = word_hashes(texts)
        return *_padded(self.ids(h), counts), counts

    def log_counts(self, h: np.ndarray) -> np.ndarray:
        """Log of how often each word occurs, NaN for words that are not among the frequent ones."""
        if not len(self.often):
            return np.full(len(h), np.nan)
        at = np.minimum(np.searchsorted(self.often, h), len(self.often) - 1)
        return np.where(self.often[at] == h, np.log(self.often_n)[at], np.nan)


def _padded(types: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Types of consecutive texts of ``counts`` words with padding around each text, and the places of the words."""
    at = np.arange(len(types)) + SIDE * (np.repeat(np.arange(len(counts)), counts) + 1)
    ids = np.full(len(types) + SIDE * (len(counts) + 1), PAD)
    ids[at] = types
    return ids, at


def _frequent(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most ``OFTEN`` words, none rarer than any other word, and how often each occurs.

    Words are told apart by eighths of powers of two of their counts, so that neither a sort nor one task has to see them all.
    """
    level = F.floor(8 * F.log2("n")).cast("int")
    sizes = sums.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    many = np.cumsum([r.words for r in sizes])
    if not len(many) or many[0] > OFTEN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = sizes[int(np.searchsorted(many, OFTEN, "right")) - 1].level
    rows = sums.filter(level >= least).toArrow()
    words, n = rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def count_words(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, np.ndarray]:
    """The most frequent words of all documents, ties by hash, and how often each type occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, counts = np.unique(word_hashes(byte_texts(b.column(0)))[0], return_counts=True) if b.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])

    sums, path = store(docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = sums.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    frequency = np.zeros(TYPES)
    frequency[: len(top)] = [r.n for r in top]
    kind = F.expr(f"int({KNOWN} + (word & {HASHED - 1}))")
    rest = sums.filter(~F.col("word").isin([r.word for r in top])) if top else sums
    for r in rest.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n")).collect():
        frequency[r.kind] = r.n
    order = np.argsort(words)
    return Vocabulary(words[order], order.astype(np.int64), path, *_frequent(sums)), frequency


def train(docs: DataFrame, vocabulary: Vocabulary, frequency: np.ndarray, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, share: int = SHARE) -> Window:
    """Network after ``rounds`` averaged passes, each over one ``share``-th of the documents, dealt by a hash of key and text.

    As many rounds as shares train on every document once; further ones start again with the first share.
    """
    net = new_window(frequency)
    for r in range(rounds):
        start = net.flat()

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            trainer, many = Trainer(Window.of(start)), 0
            draw = np.random.default_rng(11)
            for b in batches:
                texts = byte_texts(b.column(0))
                for lo, hi in chunks(texts):
                    ids, at, _ = vocabulary.padded(texts[lo:hi])
                    at = draw.permutation(at)
                    for i in range(0, len(at), BATCH):
                        trainer.step(ids, at[i : i + BATCH])
                    many += len(at)
            if many:
                flat = trainer.net.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * many), pa.array(np.full(len(flat), float(many)))], ["i", "v", "w"])

        part = docs.filter(F.expr(f"pmod(xxhash64(`{key}`, `{text}`), {share}) = {r % share}")).select(text)
        mean = part.mapInArrow(run, "i long, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"))
        rows = mean.toArrow()
        if rows.num_rows:
            flat = start.astype(np.float64)
            flat[rows["i"].to_numpy()] = rows["v"].to_numpy()
            net = Window.of(flat)
    return net


def pseudo_likelihood(docs: DataFrame, net: Window, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, log_likelihood, per_token) of every row and whole text.

    A text without words, null included, has 0 tokens, the sum 0 and null per token. Repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sums, sizes = byte_texts(b.column(1)), [], []
            for lo, hi in chunks(texts):
                ids, at, counts = vocabulary.padded(texts[lo:hi])
                run_ = np.concatenate([[0.0], np.cumsum(net.log_probabilities(ids, at), dtype=np.float64)])
                ends = np.cumsum(counts)
                sums += (run_[ends] - run_[ends - counts]).tolist()
                sizes += counts.tolist()
            mean = [s / n if n else None for s, n in zip(sums, sizes)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(mean, pa.float64())], [key, "n_tokens", "log_likelihood", "per_token"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, n_tokens long, log_likelihood double, per_token double")


def token_likelihood(docs: DataFrame, net: Window, vocabulary: Vocabulary, frequency: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Like :func:`pseudo_likelihood`, but of the words themselves: a word that shares its type counts among the words of that type.

    Each type keeps one count for words that the corpus of the vocabulary does not have. Words with a type of their own need no more than the network.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            keys, texts = b.column(0), byte_texts(b.column(1))
            for lo, hi in chunks(texts):
                h, counts = word_hashes(texts[lo:hi])
                types = vocabulary.ids(h)
                ids, at = _padded(types, counts)
                own, n = np.repeat(np.arange(hi - lo), counts), hi - lo
                sums = np.bincount(own, net.log_probabilities(ids, at), n)
                shared = np.flatnonzero(types >= KNOWN)
                logs = vocabulary.log_counts(h[shared])
                sums += np.bincount(own[shared], np.where(np.isnan(logs), 0.0, logs) - np.log(frequency + 1)[types[shared]], n)
                shared = shared[np.isnan(logs)]
                rows = row + np.arange(n)
                # one row for each rare word, and one for the document, whose word is in no table
                word = np.concatenate([mix(rows.astype(np.uint64), 3), h[shared]]).view(np.int64)
                many = len(shared)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, rows[own[shared]]])),
                        pa.array(word),
                        pa.array(np.concatenate([np.zeros(n, np.int64), np.ones(many, np.int64)])),
                        pa.concat_arrays([keys[lo:hi], pa.nulls(many, pa.int64())]),
                        pa.array(np.concatenate([counts, np.zeros(many, np.int64)]).astype(np.int64)),
                        pa.array(np.concatenate([sums, np.zeros(many)])),
                    ],
                    ["row", "word", "shared", "key", "n_tokens", "v"],
                )
                row += n

    parts = docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(run, "row long, word long, shared long, key long, n_tokens long, v double")
    words = docs.sparkSession.read.schema("word long, n long").parquet(vocabulary.counts)
    score = F.col("v") + F.when(F.col("shared") == 1, F.log(F.coalesce(F.col("n"), F.lit(1)))).otherwise(0.0)
    whole = parts.join(words, "word", "left").groupBy("row").agg(F.max("key").alias(key), F.sum("n_tokens").alias("n_tokens"), F.sum(score).alias("log_likelihood"))
    return whole.select(key, "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token"))
