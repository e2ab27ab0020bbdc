"""Alignment of two tokenizers by pointer jumping, and how often their ids meet in the corpus.

Every token points to the farthest-right token that overlaps it; doubling the pointers brings each token to the last one of its
group, which ends where tokens of both sides end. The links, pairs of overlapping tokens, are counted over the corpus: the pairs of
each text are stored, summed, and the sums brought back. The most frequent pairs are a table of at most `HEAD` rows, which is
broadcast and covers most rows of every text; the rare ones are joined by exchange, so that no frequent pair gathers in one task.

Defined results: null, empty and mismatched texts (a side's token bytes differ from a space and the text) have zeros and an empty
digest. Every row has a result row of its own, rows with null or repeated ids too. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.store import byte_texts, chunks, list_column, release, store

#: Rows of the table of frequent pairs that is broadcast: 16 bytes each.
HEAD = 1 << 16

#: Bytes of text whose tokens are in arrays at once, pieces that a task remembers, pieces encoded as one text; batching only.
BLOCK_BYTES, MEMO, JOINED = 1 << 19, 200_000, 2000

Encode = Callable[[list[str]], list[list[int]]]


def byte_level_table(path: str) -> tuple[Encode, list[bytes]]:
    """Ids by a byte-level BPE of the tokenizers library, and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    table = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast([f" {x}" for x in texts], add_special_tokens=False)], table


def piece_table(path: str) -> tuple[Encode, list[bytes]]:
    """Ids by a sentencepiece model, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return lambda texts: model.encode(texts, num_threads=1), table


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token of side A, then of side B, the A token that ends its group.

    Tokens of a side follow without holes, both sides cover the same bytes, and none is empty.
    """
    size = len(ends_a)
    last_b = np.searchsorted(ends_b, ends_a, "left")  # the B token that holds the last byte of the A token
    last_a = np.searchsorted(ends_a, ends_b, "left")
    own = np.arange(size)
    to = np.concatenate([np.where(ends_b[last_b] > ends_a, size + last_b, own), last_a])
    while True:
        onward = to[to]
        if np.array_equal(onward, to):
            return to
        to = onward


def _links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens of every overlapping pair, by A token."""
    first = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]]), "right")
    count = np.searchsorted(ends_b, ends_a, "left") - first + 1
    a = np.repeat(np.arange(len(ends_a)), count)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Aligner:
    """Alignment of texts; ``width`` is the size of the second vocabulary, so that an id pair is a * width + b.

    Where ``split`` is given, no token of either side crosses such a space, so groups don't either: texts are cut there, and each
    distinct piece is aligned once. Pieces already met are remembered, up to `MEMO` of them; new ones are encoded many at a time, as
    a text with spaces between them.
    """

    def __init__(self, a: tuple[Encode, list[bytes]], b: tuple[Encode, list[bytes]], split: re.Pattern | None = None):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = a, b
        self.split, self.known = split, {}
        self.width = len(self.bytes_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        # an id followed by what comes between tokens: A within a group, A before its B tokens, B within a group, B before the next group
        self.shown = [b"%d," % i for i in range(len(self.bytes_a))] + [b"%d|" % i for i in range(len(self.bytes_a))]
        self.shown += [b"%d," % i for i in range(self.width)] + [b"%d;" % i for i in range(self.width)]

    def _joined(self, texts: list[str]) -> Iterator[list[int]]:
        """Numbers of pieces to encode as one text: pieces without white space at their ends, with spaces between; others alone."""
        run: list[int] = []
        for i, x in enumerate(texts):
            if not self.split or not x or x[0].isspace() or x[-1].isspace():
                yield [i]
                continue
            run.append(i)
            if len(run) == JOINED:
                yield run
                run = []
        if run:
            yield run

    def pieces(self, texts: list[str]) -> list[tuple | None]:
        """For each text: tokens of A and of B, groups, the groups as text, the id pairs of its links; None where the bytes differ."""
        out: list[tuple | None] = [None] * len(texts)
        rows, size = [], [len(x.encode()) + 1 for x in texts]
        todo = list(self._joined(texts))
        while todo:
            whole = [" ".join([texts[i] for i in run]) for run in todo]
            parts = zip(todo, whole, self.encode_a(whole), self.encode_b(whole), strict=True)
            todo = []
            for run, text, a, b in parts:
                raw = b" " + text.encode()
                if b"".join([self.bytes_a[t] for t in a]) == raw and b"".join([self.bytes_b[t] for t in b]) == raw:
                    rows.append((run, a, b))
                elif len(run) > 1:
                    todo += [[i] for i in run]
        if not rows:
            return out
        a, b = (np.array([t for r in rows for t in r[side]], np.int64) for side in (1, 2))
        number = [i for r in rows for i in r[0]]
        ends = np.cumsum([size[i] for i in number])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # texts follow each other, so each ends a group
        to = terminals(ends_a, ends_b)
        last_a = to[: len(a)] == np.arange(len(a))
        until = np.cumsum(last_a)
        group_a, group_b = until - last_a, until[to[len(a) :]] - 1
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        # groups as text: the A tokens of a group, then its B tokens
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + np.where(last_a, len(self.bytes_a), 0)
        codes[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * len(self.bytes_a) + b + np.where(last_b, self.width, 0)
        words = [self.shown[c] for c in codes.tolist()]
        at_a, at_b = _links(ends_a, ends_b)
        pairs = (a[at_a] * self.width + b[at_b]).tobytes()
        stop_a, stop_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        stops = np.stack([stop_a, stop_b, until[stop_a - 1], stop_a + stop_b, 8 * np.searchsorted(at_a, stop_a)])
        counts = np.diff(stops[:3], axis=1, prepend=0)
        from_pair = from_word = 0
        for i, x, y, g, word, pair in zip(number, *counts.tolist(), *stops[3:].tolist(), strict=True):
            out[i] = (x, y, g, b"".join(words[from_word:word])[:-1], pairs[from_pair:pair])
            from_pair, from_word = pair, word
        return out

    def block(self, texts: list[bytes]) -> list[tuple]:
        """For each text: tokens of A and of B, groups, links, digest of the groups, distinct id pairs and their counts."""
        as_text = [x.decode() for x in texts]
        cut = [self.split.split(x) if self.split else [x] for x in as_text]
        new = list({p for parts in cut for p in parts}.difference(self.known))
        made = dict(zip(new, self.pieces(new), strict=True))
        known = self.known
        known.update(made)
        out = []
        for text, parts in zip(as_text, cut, strict=True):
            done = [known[p] for p in parts] if text else [None]
            if None in done and len(done) > 1:  # bytes that differ in pieces might still be equal as a whole
                done = self.pieces([text])
            if None in done:
                out.append((0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)))
                continue
            n_a, n_b, groups, shown, raw = zip(*done, strict=True)
            pairs = np.frombuffer(b"".join(raw), np.int64)
            mine, times = np.unique(pairs, return_counts=True)
            out.append((sum(n_a), sum(n_b), sum(groups), len(pairs), hashlib.sha256(b";".join(shown)).hexdigest(), mine, times))
        if len(known) > MEMO:  # the pieces that were met first stay, as most frequent ones are among them
            for p in list(itertools.islice(known, MEMO if self.split else 0, None)):
                del known[p]
        return out


def cut_pattern(byte_path: str, piece_path: str) -> re.Pattern | None:
    """Single spaces between other characters, where both tokenizers are known to begin a token there; else None.

    The byte-level pattern never puts a space behind another character into one token. The pieces don't either, if none has a
    space behind another character.
    """
    with open(byte_path, encoding="utf-8") as f:
        before = json.load(f)
    plain = before["normalizer"] is None and before["pre_tokenizer"]["type"] == "ByteLevel" and before["pre_tokenizer"].get("use_regex", True)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    crossing = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    return re.compile(r" (?<=\S )(?=\S)") if plain and not crossing else None


_STORED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, key: str, text: str, make: Callable[[], Aligner]) -> DataFrame:
    """``doc_id`` and the alignment of every text, with its distinct id pairs; ``make()`` runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = make()
        for batch in batches:
            texts = byte_texts(batch.column(1))
            for lo, hi in chunks(texts, BLOCK_BYTES):
                rows = aligner.block(texts[lo:hi])
                counts = np.array([len(r[5]) for r in rows])
                lists = [list_column(np.concatenate([r[at] for r in rows]), counts, kind) for at, kind in ((5, pa.int64()), (6, pa.int32()))]
                plain = [pa.array([r[at] for r in rows], pa.string() if at == 4 else pa.int64()) for at in range(5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *plain, *lists], [f.name for f in schema.fields])

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *T._parse_datatype_string(_STORED).fields])
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: tokens of both sides, groups, links, links at their B id's highest count, sum of the counts, digest."""
    spark = docs.sparkSession
    width = len(piece_table(piece_path)[1])
    # the number of a row is stored with it, so reading again gives the same one
    done = aligned(docs, key, text, lambda: Aligner(byte_level_table(byte_path), piece_table(piece_path), cut_pattern(byte_path, piece_path))).withColumn("row", F.monotonically_increasing_id())
    rows, rows_at = store(done, "aligned")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    counts, counts_at = store(links.groupBy("pair").agg(F.sum("times").alias("total")), "pair-counts")
    second = F.pmod("pair", F.lit(width))
    highest = counts.groupBy(second.alias("b")).agg(F.max("total").alias("highest"))
    totals, totals_at = store(counts.withColumn("b", second).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best")), "pair-totals")
    frequent, frequent_at = store(totals.orderBy(F.desc("total"), "pair").limit(head), "frequent-pairs")
    met = links.join(F.broadcast(frequent), "pair", "left")
    rare = met.filter("total is null").select("row", "pair", "times").join(totals, "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum")]
    # both parts are summed by text before they are exchanged
    parts = met.filter("total is not null").groupBy("row").agg(*sums).unionByName(rare.groupBy("row").agg(*sums))
    summed = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    result, _ = store(rows.drop("pairs", "times").join(summed, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256"), "alignment")
    release(spark, rows_at, counts_at, totals_at, frequent_at)
    return result
