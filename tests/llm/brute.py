"""Plain versions of the operators, and a small corpus with the awkward rows that each of them must stand."""

from __future__ import annotations

import random
import re

A_Z = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, __id long, sha string"


def messy_rows(seed: int = 1, many: int = 120) -> list[tuple]:
    """Near copies, exact copies up to case, short, empty, null and very long texts, a repeated row, rows without key."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts: list[str | None] = []
    for _ in range(many):
        kind = r.random()
        if texts and kind < 0.35:
            base = (r.choice(texts) or "").split()
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                if base:
                    base[r.randrange(len(base))] = r.choice(words)
            texts.append(" ".join(base))
        elif texts and kind < 0.45:
            texts.append((r.choice(texts) or "").upper())
        else:
            texts.append(" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 4, 5, 30, 80]))))
    texts += [None, None, "", " \t\n", "é É ß", "x" * 5000, " ".join(r.choice(words) for _ in range(30_000)), "a b c", "A b  c", "a b"]
    rows = [(i * 3 + 1, t, "en", None if i % 7 else "s", None, 1, 0.5, 2, "x") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[5], None, None, None, None, None, None, None), (None, "alone here with no key at all", None, None, None, None, None, None, None)]
    r.shuffle(rows)
    return rows


def shingles(text: str | None, width: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(A_Z))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(rows: list[tuple[int, str | None]], width: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """doc_id: (size of its set, least doc_id that links reach), over rows with a doc_id."""
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    least = {i: i for i in sets}

    def root(x: int) -> int:
        while least[x] != x:
            x = least[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = root(a), root(b)
                least[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}
