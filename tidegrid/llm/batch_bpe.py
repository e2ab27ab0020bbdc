"""Byte-pair ids of whole batches of texts: each distinct run between white space is looked up once, new words are merged together.

The ids are those of ``bpe.WordBpe``. No word crosses white space, so a text is the sequence of its runs. Runs are told apart by a 64-bit
hash of their lower-case bytes, by which two given ones are confused with probability 2**-64; runs over ``MEMO_CHARS`` bytes, and those with
a ``<``, where special tokens are told apart by case, are encoded one at a time. New words lie in one matrix per length, where every
row merges its leftmost pair of least rank and so moves on to the matrix of the next smaller length.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from itertools import chain, compress

import numpy as np

from tidegrid.llm.bpe import _ASCII_WORDS, _LATER_CAPITALS, _LATER_LOWER, MEMO_CHARS, WordBpe, all_words
from tidegrid.llm.shingles import buffer_hashes

MEMO = 300_000  # runs that a worker remembers; of more, those met more than once survive
_NONE = np.int32(1 << 30)


def ragged(flat: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that start at ``at`` and have ``counts`` values, one behind the other."""
    ends = np.cumsum(counts)
    return flat[np.repeat(at - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of one of each, the number of each key among them, and how often each occurs."""
    order = np.argsort(keys)  # which one of equal keys comes first is open, and a stable sort takes twice the time
    ordered = keys[order]
    head = np.flatnonzero(np.append(np.ones(min(len(keys), 1), bool), ordered[1:] != ordered[:-1]))
    counts = np.diff(np.append(head, len(keys)))
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(head)), counts)
    return ordered[head], order[head], number, counts


@cache
def _cutters() -> tuple[re.Pattern, re.Pattern]:
    """Words and line feeds, of ASCII text and of any text."""
    return re.compile(f"\n|{_ASCII_WORDS}"), re.compile(f"\n|{all_words().pattern}")


def _lower(text: str) -> str:
    """NFC in lower case, character by character."""
    if text.isascii():
        return text.lower()
    text = "σ".join([part.lower() for part in unicodedata.normalize("NFC", text).split("Σ")])
    return text.translate(_LATER_LOWER) if _LATER_CAPITALS.search(text) else text


class BatchBpe:
    def __init__(self, spec: bytes):
        self.single = WordBpe(spec)
        merges = self.single.merges
        keys = np.array([a << 32 | b for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.pairs = keys[order]
        self.ranks = np.array([rank for rank, _ in merges.values()], np.int32)[order]
        self.made = np.zeros(int(self.ranks.max(initial=0)) + 1, np.int32)
        self.made[self.ranks] = np.array([made for _, made in merges.values()], np.int32)[order]
        self.inner, self.last = np.array(self.single.inner, np.int32), np.array(self.single.last, np.int32)
        # ranks of the pairs of bytes that a word begins with, inside it and at its end
        self.first = self._rank(np.repeat(self.inner, 256), np.tile(self.inner, 256)), self._rank(np.repeat(self.inner, 256), np.tile(self.last, 256))
        self._forget()

    def _forget(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of runs, and their numbers
        self.pool = np.zeros(0, np.uint32)
        self.at, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, ``_NONE`` where there is no such merge."""
        if not len(self.pairs):
            return np.full(left.shape, _NONE)
        key = left.astype(np.int64) << 32 | right
        found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[found] == key, self.ranks[found], _NONE)

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and their number by word."""
        flat = np.frombuffer("\n".join([*words, ""]).encode("utf-8", "surrogatepass"), np.uint8)  # no word has a line feed
        ends = np.flatnonzero(flat == 10)
        sizes = np.diff(ends, prepend=-1) - 1
        starts = ends - sizes
        counts = np.zeros(len(words), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def put(rows: np.ndarray, ids: np.ndarray) -> None:
            counts[rows] = ids.shape[1]
            done.append((rows, ids))

        for w in np.flatnonzero(sizes > MEMO_CHARS).tolist():
            put(np.array([w]), np.array([self.single.merge(words[w])], np.int32))
        rows, ids, rank = np.zeros(0, np.int64), np.zeros((0, MEMO_CHARS), np.int32), np.zeros((0, MEMO_CHARS - 1), np.int32)
        for width in range(MEMO_CHARS, 0, -1):
            new = np.flatnonzero(sizes == width)
            if len(new):
                b = flat[starts[new, None] + np.arange(width)]
                symbols = self.inner[b]
                symbols[:, -1] = self.last[b[:, -1]]
                rows, ids = np.append(rows, new), np.concatenate([ids, symbols])
                two = b[:, :-1].astype(np.intp) << 8 | b[:, 1:]
                ranks = self.first[0].take(two)
                ranks[:, -1:] = self.first[1].take(two[:, -1:])
                rank = np.concatenate([rank, ranks])
            if width == 1:
                break
            left = rank.argmin(1)
            best = rank[np.arange(len(rows)), left]
            open_ = best < _NONE
            put(rows[~open_], ids[~open_])
            rows, ids, rank, left, best = rows[open_], ids[open_], rank[open_], left[open_], best[open_]
            each = np.arange(len(rows))
            ids[each, left] = self.made[best]
            keep = np.ones(ids.shape, bool)
            keep[each, left + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            keep = np.ones(rank.shape, bool)
            keep[each, left] = False
            rank = rank[keep].reshape(len(rows), width - 2)
            for near, some in ((left - 1, left > 0), (left, left < width - 2)):
                e, p = each[some], near[some]
                rank[e, p] = self._rank(ids[e, p], ids[e, p + 1])
        put(rows, ids[:, :1])
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for r, values in done:
            out[(ends - counts)[r, None] + np.arange(values.shape[1])] = values
        return out, counts

    def _encode_runs(self, *parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ASCII runs and then of other runs, none with a line feed or a special token; and their number by run."""
        found = [cutter.findall(_lower("\n".join([*runs, ""]))) for runs, cutter in zip(parts, _cutters())]
        words = list(dict.fromkeys(chain("\n", *found)))
        numbers = dict(zip(words, range(len(words))))
        code = np.fromiter(map(numbers.__getitem__, chain(*found)), np.int64, sum(map(len, found)))
        flat, counts = self.merge_all(words[1:])
        counts = np.append(0, counts)
        ids = ragged(flat, (np.cumsum(counts) - counts)[code], counts[code])
        return ids, np.diff(np.cumsum(counts[code])[code == 0], prepend=0)

    def _remember(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of new entries; none of the keys is known."""
        first = len(self.at)
        self.at = np.append(self.at, len(self.pool) + np.cumsum(counts) - counts)
        self.size, self.met = np.append(self.size, counts), np.append(self.met, np.zeros(len(counts), np.int64))
        self.pool = np.append(self.pool, ids)
        order = np.argsort(keys)
        place = np.searchsorted(self.known, keys[order])
        self.known, self.number = np.insert(self.known, place, keys[order]), np.insert(self.number, place, first + order)
        return np.arange(first, first + len(counts))

    def _trim(self) -> None:
        if len(self.known) < MEMO:
            return
        keys, numbers = self.known, self.number
        often = self.met[numbers] > 1
        at, size, pool = self.at[numbers[often]], self.size[numbers[often]], self.pool
        self._forget()
        if 2 * len(at) < MEMO:
            self._remember(keys[often], ragged(pool, at, size), size)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts and their number by text; the lower-case hash of every run, and the number of runs by text."""
        self._trim()
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        starts, ends, hashes = buffer_hashes(raw)
        runs = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
        alone = ends - starts > MEMO_CHARS
        alone[np.searchsorted(starts, np.flatnonzero(raw == ord("<")), "right") - 1] = True
        number = np.zeros(len(starts), np.int64)
        kept = np.flatnonzero(~alone)
        keys, first, place, met = _groups(hashes[kept])
        found = np.full(len(keys), -1)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            there = self.known[near] == keys
            found[there] = self.number[near[there]]
        new = np.flatnonzero(found < 0)

        def strings(which: np.ndarray) -> list[str]:
            return [joined[a:b].decode() for a, b in zip(starts[which].tolist(), ends[which].tolist())]

        if len(new):
            texts_ = strings(kept[first[new]])
            ascii_ = [s.isascii() for s in texts_]
            plain = np.array(ascii_)
            new = np.append(new[plain], new[~plain])
            parts = list(compress(texts_, ascii_)), list(compress(texts_, (~plain).tolist()))
            found[new] = self._remember(keys[new], *self._encode_runs(*parts))
        self.met[found] += met
        number[kept] = found[place]
        pool, at, size = self.pool, self.at, self.size
        if alone.any():  # for this batch only
            own = [np.frombuffer(self.single.encode(s), np.uint32) for s in strings(np.flatnonzero(alone))]
            counts = np.array([len(x) for x in own], np.int64)
            number[alone] = len(at) + np.arange(len(own))
            at, size = np.append(at, len(pool) + np.cumsum(counts) - counts), np.append(size, counts)
            pool = np.concatenate([pool, *own])
        counts = size[number]
        total = np.append(0, np.cumsum(counts))
        upto = np.cumsum(runs)
        return ragged(pool, at[number], counts), total[upto] - total[upto - runs], hashes, runs

