"""Byte-pair encoding and decoding with a public vocabulary of the word kind.

Texts are normalised (NFC, white space to one space, lower case per character), cut into words, and each word starts as a doubly linked
list of byte symbols, the last one marked as the end of the word. A priority queue holds the adjacent pairs by merge rank; an entry whose
symbols have changed meanwhile is stale and skipped. Decoding concatenates vocabulary strings with the vocabulary's separator, a space.

Workers get the vocabulary by a Spark broadcast, whose size is that of the file, and remember the ids of words.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMO = 300_000  # words, and runs between white space, that a worker remembers
MEMO_CHARS = 64  # longer words are not kept
# Fixed values of the vocabulary's format: white space, and the words of a text (letters, one digit, or other symbols).
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"
_ASCII_WORDS = _WORDS.format(letters="a-z", numbers="0-9", space=r"\t-\r ")
_NO_SPACE = "\x1c\x1d\x1e\x1f"  # white space for str.split alone
END = "</w>"
# Code points that are letters, numbers and capitals only in Unicode versions later than 15.1.
_LATER = {
    "L": r"\U00001c89-\U00001c8a\U0000a7cb-\U0000a7cd\U0000a7da-\U0000a7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b"
    r"\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0",
    "N": r"\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa",
}
_LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_LATER_CAPITALS = re.compile("[" + "".join(map(chr, _LATER_LOWER)) + "]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@cache
def all_words() -> re.Pattern:
    """Words of any text; letters and numbers by Python's own Unicode tables and what later versions added."""
    spans: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        kind = spans.get(unicodedata.category(chr(c))[0])
        if kind is not None:
            if kind and kind[-1][1] == c - 1:
                kind[-1][1] = c
            else:
                kind.append([c, c])
    letters, numbers = (_LATER[k] + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans[k]) for k in "LN")
    return re.compile(_WORDS.format(letters=letters, numbers=numbers, space=_SPACE))


class WordBpe:
    def __init__(self, spec: bytes):
        made = json.loads(spec)
        self.vocab: dict[str, int] = made["model"]["vocab"]
        special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        self.strings = {i: s for s, i in (self.vocab | special).items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        chars = byte_symbols()
        self.inner = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + END] for c in chars]
        self.ascii_words = re.compile(_ASCII_WORDS)
        self.memo: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        queue = [(found[0], i, found[1], ids[i], ids[i + 1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, made, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((made, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1], made, ids[k]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], made))):
                heapq.heappush(queue, (found[0], h, found[1], ids[h], made))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        ids = self.memo.get(word)
        if ids is None:
            ids = array("I", self.merge(word)).tobytes()
            if len(word) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def _run(self, run: str) -> bytes:
        """Ids of lower-case text, cut into words."""
        if run.isascii():
            return b"".join([self._word(w) for w in self.ascii_words.findall(run)])
        if _LATER_CAPITALS.search(run):
            run = run.translate(_LATER_LOWER)
        return b"".join([self._word(w) for w in all_words().findall(run)])

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no final sigma
        if any(c in low for c in _NO_SPACE):
            return [self._run(low)]
        # no word crosses white space, so what stands between it can be remembered as a whole
        runs, out = self.runs, []
        for r in low.split():
            ids = runs.get(r)
            if ids is None:
                ids = self.older.get(r) or self._run(r)
                if len(r) <= MEMO_CHARS:
                    if len(runs) >= MEMO:  # what is met again survives
                        self.older, self.runs = runs, {}
                        runs = self.runs
                    runs[r] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<" not in text:
            return b"".join(self._plain(text))
        parts: list[bytes] = []
        for i, part in enumerate(self.cut.split(text)):
            parts += [array("I", [self.special[part]]).tobytes()] if i % 2 else self._plain(part)
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in memoryview(ids).cast("I")])


_loaded: dict[int, WordBpe] = {}


def broadcast_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def loaded(spec: Broadcast) -> WordBpe:
    """The encoder of this worker, built once per vocabulary."""
    key = hash(spec.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec.value)
    return _loaded[key]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every row: ids as little-endian 32-bit integers, and the text that they decode to.

    Null texts count as empty, whose ids and text are empty. Rows are independent: repeated ones and null keys stay, other columns are
    not read.
    """
    spec = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec)
        kinds = (pa.int64(), pa.binary(), pa.string())
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            held = 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = bpe.encode(t or "")
                for col, value in zip(out, (k, ids, bpe.decode(ids))):
                    col.append(value)
                held += len(ids)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], [key, "ids", "decoded"])
                    out, held = ([], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], [key, "ids", "decoded"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` long, ids binary, decoded string")
