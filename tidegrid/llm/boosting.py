"""Gradient-boosted trees with logistic loss on binned dense features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64
DEPTH = 3
TREES = 80
RATE = 0.15
RIDGE = 1.0
LEAST_WEIGHT = 2.0  # sum of p (1 - p) that a child must have


@dataclass
class Trees:
    """Complete binary trees: node i has the children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # a row goes right when its value is above
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j]) for j in range(width)])
    inner = 2**DEPTH - 1
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    raw = np.full(n, base)
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for j in range(width):
                at = (node - first) * BINS + binned[j]
                g = np.bincount(at, grad, many * BINS).reshape(many, BINS)
                h = np.bincount(at, hess, many * BINS).reshape(many, BINS)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
                gain[:, len(edges[j]) :] = 0  # the last bin has no upper edge
                where = gain.argmax(1)
                top = gain[np.arange(many), where]
                for k in np.flatnonzero(top > best):
                    best[k], feature[t, first + k], cut[t, first + k] = top[k], j, edges[j][where[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > cut[t][node])
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        leaf[t] = RATE * g / (h + RIDGE)
        raw += leaf[t][node - inner]
    return Trees(base, feature, cut, leaf)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit of ``y`` by pooling adjacent violators: knots and values for linear interpolation."""
    knots, at = np.unique(raw, return_inverse=True)
    weight = np.bincount(at).astype(float)
    value = np.bincount(at, y) / weight
    pool: list[list[float]] = []  # value, weight, first, last
    for i, (v, w) in enumerate(zip(value, weight)):
        pool.append([v, w, i, i])
        while len(pool) > 1 and pool[-2][0] >= pool[-1][0]:
            v2, w2, _, last = pool.pop()
            v1, w1, first, _ = pool.pop()
            pool.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, first, last])
    xs, ys = [], []
    for v, _, first, last in pool:
        for k in dict.fromkeys((first, last)):
            xs.append(knots[k])
            ys.append(v)
    return np.array(xs), np.array(ys)
