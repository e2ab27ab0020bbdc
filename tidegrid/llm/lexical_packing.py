"""Packing by lexical retrieval: a seed document draws its nearest unused neighbours into its window.

Documents are ordered by a lexical key (the least word hash, which copies and similar texts share often) and dealt by range into shards of
bounded size; a key that very many share is divided by the document key. The BM25 weights come from counts over the whole corpus: documents, their
mean length, and the documents of each term. Each shard builds an inverted index over the token ids of its documents, and neighbours are looked for in it. The first
unused document is the seed of a window; the unused documents that score best for all its terms follow until the window is
full. The one that crosses the end is cut, and its rest opens the next window. So windows have no padding; what is left at the
end of a shard is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.batch_bpe import BatchBpe
from tidegrid.llm.bpe import WordBpe, broadcast_vocabulary
from tidegrid.llm.store import byte_texts, chunks, frugal, mix, rows_per_batch, store

WINDOW = 4096
CHUNK_BYTES = 1 << 20  # of text that is encoded at once; batching only
BATCH_ROWS = 1000  # whole texts that a worker gets at once; batching only
TOKENS = 1 << 18  # of documents that are counted at once; batching only
SHARD_BYTES = 12_000_000  # of text, on average
K1, B = 1.2, 0.75


@dataclass
class Corpus:
    """Counts behind the weights: documents, their mean length, and by term the documents that have it."""

    n: int
    mean: float
    df: np.ndarray


def distinct(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some documents after others: the sorted distinct ids of each, one behind the other, how often each occurs, and their number by document."""
    ends = np.cumsum([len(d) for d in docs])
    lo = 0
    while lo < len(docs):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
        some = np.concatenate(docs[lo:hi])
        shift = 8 * some.itemsize
        kind = np.uint32 if hi - lo <= 1 << 32 - shift else np.uint64
        keys = np.repeat(np.arange(hi - lo, dtype=kind) << kind(shift), np.diff(ends[lo:hi], prepend=before))
        keys |= some
        keys.sort()
        first = np.flatnonzero(np.append(np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))
        found = keys[first]
        yield found.astype(some.dtype), np.diff(np.append(first, len(keys))), np.bincount((found >> kind(shift)).astype(np.intp), minlength=hi - lo)
        lo = hi


class Bm25:
    """Inverted index of one shard: postings of each term with their weights, by the counts of ``corpus`` or else of the shard.

    Terms that an eighth of the documents have are also rows of a matrix, where adding them up reads memory in order.
    """

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        found = list(zip(*distinct(docs)))
        self.n = len(docs)
        term, tf, sizes = np.concatenate(found[0]), np.concatenate(found[1]).astype(np.float64), np.concatenate(found[2])
        del found
        self.terms = np.split(term, np.cumsum(sizes)[:-1])
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        here = np.bincount(term)
        length = np.array([len(d) for d in docs], np.float64)
        corpus = corpus or Corpus(self.n, length.mean(), here)
        idf = np.log1p((corpus.n - corpus.df + 0.5) / (corpus.df + 0.5))
        weight = idf[term]  # in place: with large shards each copy counts
        weight *= tf
        weight *= K1 + 1
        tf += (K1 * (1 - B + B * length / corpus.mean))[owner]
        weight /= tf
        del tf
        order = np.argsort(term, kind="stable")
        del term
        self.ids = np.arange(self.n)  # documents that the postings are about, and owners are places in it
        self.owner, self.weight = owner[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(here)])
        self._spread()

    def _spread(self) -> None:
        counts = np.diff(self.at)
        common = np.flatnonzero(counts * 8 > len(self.ids))
        self.row = np.full(len(counts), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), len(self.ids)))
        for r, t in enumerate(common.tolist()):
            p = slice(self.at[t], self.at[t + 1])
            self.rows[r, self.owner[p]] = self.weight[p]

    def drop(self, unused: np.ndarray) -> None:
        """Forget the postings of documents that are used up."""
        self.rows = np.zeros((0, 0))  # made anew below
        live = unused[self.ids]
        keep = live[self.owner]
        self.at = np.append(0, np.cumsum(keep))[self.at]
        self.owner, self.weight = (np.cumsum(live, dtype=np.int32) - 1)[self.owner[keep]], self.weight[keep]
        self.ids = self.ids[live]
        self._spread()

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with the seed, best first; ties by position. Only as far as it is read is it put in order."""
        terms = self.terms[seed]
        row = self.row[terms]
        parts = [slice(self.at[t], self.at[t + 1]) for t in terms[row < 0].tolist()]
        score = np.zeros(len(self.ids))
        for r in row[row >= 0].tolist():  # one at a time, without a copy of the rows
            score += self.rows[r]
        if parts:
            score += np.bincount(np.concatenate([self.owner[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), len(self.ids))
        ids = self.ids
        score[~unused[ids]] = 0
        rest, take = np.flatnonzero(score), 32
        while len(rest):
            best = score[rest]
            if len(rest) > take:
                bar = np.partition(best, -take)[-take]
                top, rest = rest[best >= bar], rest[best < bar]
            else:
                top, rest = rest, rest[:0]
            yield from ids[top[np.argsort(-score[top], kind="stable")]].tolist()
            take *= 4

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """All of ``ranked``."""
        return list(self.ranked(seed, unused))


def fill_windows(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every token of every document is in exactly one."""
    index = Bm25(docs, corpus)
    unused = np.ones(len(docs), bool)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = filled = 0
    queue: Iterator[int] = iter(())

    def put(doc: int) -> bool:
        """Place a document, over as many windows as it takes; whether a window was closed."""
        nonlocal sequence, filled
        start, closed = 0, False
        while start < len(docs[doc]):
            take = min(len(docs[doc]) - start, window - filled)
            out.append((doc, start, take, sequence, filled))
            start, filled = start + take, filled + take
            if filled == window:
                sequence, filled, closed = sequence + 1, 0, True
        return closed

    at, left = 0, len(docs)
    while left:
        # what has been used since the order was made is passed over; where no document shares a term with the seed any more, the next one is a seed
        doc = next((d for d in queue if unused[d]), None)
        seed = doc is None
        if seed:
            at += int(np.argmax(unused[at:]))
            doc = at
        unused[doc] = False
        left -= 1
        closed = put(doc)
        if 4 * left < 3 * len(index.ids):
            index.drop(unused)
        if closed and not filled:
            queue = iter(())  # the window is full and nothing is left over: the next document is a seed
        elif closed or seed:  # what opens a window is its seed
            queue = index.ranked(doc, unused)
    return _powers_of_two(out, sequence, filled)


def _powers_of_two(pieces: list[tuple[int, int, int, int, int]], last: int, size: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the unfinished last sequence of ``size`` tokens at powers of two, largest first."""
    bounds = np.cumsum([0] + [1 << k for k in reversed(range(size.bit_length())) if size >> k & 1])
    out = [p for p in pieces if p[3] != last]
    for doc, start, length, _, offset in (p for p in pieces if p[3] == last):
        while length:
            k = int(np.searchsorted(bounds, offset, "right")) - 1
            take = min(length, int(bounds[k + 1]) - offset)
            out.append((doc, start, take, last + k, offset - int(bounds[k])))
            start, offset, length = start + take, offset + take, length - take
    return out


_loaded: dict[int, BatchBpe] = {}


def _batch_bpe(spec: Broadcast) -> BatchBpe:
    """The encoder of this worker, built once per vocabulary."""
    key = hash(spec.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = BatchBpe(spec.value)
    return _loaded[key]


def _forget_encoder() -> None:
    """Drop this worker's encoder, with all runs of text that it remembers."""
    _loaded.clear()


def _encoded(docs: DataFrame, spec: Broadcast, end_id: int, kind: type) -> DataFrame:
    """(id, lexical, ids) of every document: its least word hash, and its token ids with the end."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _batch_bpe(spec)
        for b in batches:
            texts = byte_texts(b.column(1))
            for lo, hi in chunks(texts, CHUNK_BYTES):
                flat, counts, h, words = bpe.encode(texts[lo:hi])
                ends, h = np.cumsum(words), mix(h, 9)
                keys = [int(h[e - c : e].min()) >> 1 if c else -1 for e, c in zip(ends.tolist(), words.tolist())]
                to = np.cumsum(counts)
                ids = [np.append(flat[e - c : e], np.uint32(end_id)).astype(kind).tobytes() for e, c in zip(to.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["id", "lexical", "ids"])

    return docs.mapInArrow(run, "id long, lexical long, ids binary")


def _count(encoded: DataFrame, kind: type) -> Corpus:
    """Counts over all documents; what reaches the driver is one number for each term of the vocabulary."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_encoder()
        df = np.zeros(0, np.int64)
        for b in batches:
            for terms, _, _ in distinct([np.frombuffer(x, kind) for x in b.column(0).to_pylist()]):
                here = np.bincount(terms)
                if len(here) > len(df):
                    df = np.append(df, np.zeros(len(here) - len(df), np.int64))
                df[: len(here)] += here
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(df[found])], ["term", "n"])

    n, size = encoded.agg(F.count("*"), F.sum(F.octet_length("ids"))).first()
    sums = encoded.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms = sums["term"].to_numpy()
    df = np.zeros(int(terms.max(initial=-1)) + 1, np.int64)
    df[terms] = sums["n"].to_numpy()
    return Corpus(n, (size or 0) / np.dtype(kind).itemsize / max(n, 1), df)


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, start, length, doc_tokens, sequence_id, offset, ids) of each piece; ids as little-endian unsigned 32-bit integers.

    A null text counts as empty: its document is the end id alone. Repeated rows and rows without key are packed like others. Other
    columns are not read. Sequences have ``window`` tokens or, at the end of a shard, a power of two. Texts are encoded once, into a stored table.
    """
    spec = broadcast_vocabulary(docs.sparkSession, path)
    kind = np.uint16 if max(end_id, *WordBpe(spec.value).strings) < 1 << 16 else np.uint32
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        encoded, _ = store(_encoded(docs, spec, end_id, kind), "encoded")
    corpus = docs.sparkSession.sparkContext.broadcast(_count(encoded, kind))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_encoder()
        keys, docs_ = [], []
        for b in batches:
            keys += b.column(0).to_pylist()
            docs_ += [np.frombuffer(x, kind) for x in b.column(1).to_pylist()]
        if not docs_:
            return
        first = TaskContext.get().partitionId() << 32
        pieces = fill_windows(docs_, window, corpus.value)
        for lo in range(0, len(pieces), 2_000):
            part = pieces[lo : lo + 2_000]
            doc, start, length, sequence, offset = (list(x) for x in zip(*part))
            ids = [docs_[d][s : s + n].astype(np.uint32).tobytes() for d, s, n in zip(doc, start, length)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[d] for d in doc], pa.int64()),
                    *(pa.array(x, pa.int64()) for x in (start, length, [len(docs_[d]) for d in doc], [first + s for s in sequence], offset)),
                    pa.array(ids, pa.binary()),
                ],
                [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    dealt = encoded.repartitionByRange(shards, "lexical", "id").select("id", "ids")
    return dealt.mapInArrow(run, f"`{key}` long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
