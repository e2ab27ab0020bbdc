"""Word shingles of whole texts as sorted sets of 64-bit hashes, vectorised over blocks of text.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z is
lower-cased. Texts with fewer words than the width count as one shingle of all their words, texts without words have
none. Two different shingles share a hash with probability 2**-64.
"""

from __future__ import annotations

import numpy as np

from tidegrid.llm.store import chunks, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_PIECE = 1 << 16  # bytes that are hashed at once, so that their powers stay in a cache
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the worker for ordinary piece sizes."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    with np.errstate(over="ignore"):
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
    if n <= 2 * _PIECE:
        _powers[:] = made
    return made[0], made[1]


def _piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of a piece that ends with a space."""
    b = _LOWER[raw]
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    power, inverse = _tables(max(len(b) + 1, _PIECE))
    with np.errstate(over="ignore"):
        run = np.zeros(len(b) + 1, np.uint64)
        x = b.astype(np.uint64)
        x += np.uint64(1)
        x *= power[: len(b)]
        np.cumsum(x, out=run[1:])
        h = (run[ends] - run[starts]) * inverse[starts]
        return starts, ends, mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def _behind_space(raw: np.ndarray, end: int) -> int:
    """The first place from ``end`` on that is behind a space; the buffer ends with one."""
    size = 64
    while True:
        space = _SPACE[raw[end - 1 : end - 1 + size]]
        first = int(space.argmax())
        if space[first]:
            return end + first
        size *= 8


def buffer_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of a buffer that ends with a space."""
    found, at = [], 0
    while at < len(raw):
        end = _behind_space(raw, min(len(raw), at + _PIECE))
        starts, ends, h = _piece_hashes(raw[at:end])
        found.append((starts + at, ends + at, h))
        at = end
    starts, ends, h = (np.concatenate(x) for x in zip(*found))
    return starts, ends, h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    starts, _, h = buffer_hashes(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their number per text."""
    flat, sizes = [], []
    for lo, hi in chunks(texts):
        h, counts = word_hashes(texts[lo:hi])
        ends = np.cumsum(counts)
        full = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                full = mix((full ^ h[j : j + len(full)]) * np.uint64(0xD6E8FEB86659FD93), j)
        for start, end in zip((ends - counts).tolist(), ends.tolist()):
            if end - start >= width:
                part = np.sort(full[start : end - width + 1])
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
            elif end > start:
                one = np.zeros(1, np.uint64)
                with np.errstate(over="ignore"):
                    for j, x in enumerate(h[start:end]):
                        one = mix((one ^ x) * np.uint64(0xD6E8FEB86659FD93), j)
                part = mix(one, 1000 + end - start)
            else:
                part = np.zeros(0, np.uint64)
            flat.append(part)
            sizes.append(len(part))
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def fingerprints(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit value per set, equal for equal sets."""
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat, 77), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        return mix(run[ends] - run[ends - sizes] + sizes.astype(np.uint64), 78)
