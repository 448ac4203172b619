"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees side by side: node i has children 2i+1 and 2i+2.

    ``feature`` and ``threshold`` are (trees, inner nodes), ``value`` (trees, leaves); a row goes right where its
    feature is above the threshold. Nodes without a split have an infinite threshold.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        n, (trees, inner) = len(x), self.feature.shape
        node = np.zeros((n, trees), np.int64)
        tree, row = np.arange(trees), np.arange(n)[:, None]
        for _ in range(int(inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, *, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: int = 8, l2: float = 1.0) -> Trees:
    """Logistic boosting. ``monotone[f]`` is +1 or -1: the score never falls (rises) as feature f grows.

    A split on a constrained feature needs children in the right order, and bounds the values of all nodes below by
    the middle of the two, so the whole sum keeps the order. Without rows of both labels: a constant.
    """
    n, k = x.shape if len(x) else (0, 1)
    inner = 2**depth - 1
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(mean / (1 - mean))))
    if n == 0 or len(np.unique(y)) < 2:
        return out
    sign = np.zeros(k, int)
    for f, s in (monotone or {}).items():
        sign[f] = s
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    flat = binned + np.arange(k) * bins
    score = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            lo, hi = low[i], high[i]
            low[2 * i + 1] = low[2 * i + 2] = lo
            high[2 * i + 1] = high[2 * i + 2] = hi
            best = None
            if len(rows) >= 2 * least:
                at = flat[rows].ravel()
                G, H, N = (np.bincount(at, np.repeat(w, k), k * bins).reshape(k, bins).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows))))
                gt, ht, nt = G[:, -1:], H[:, -1:], N[:, -1:]
                left = np.clip(G / (H + l2), lo, hi)
                right = np.clip((gt - G) / (ht - H + l2), lo, hi)
                gain = _gain(G, H, left, l2) + _gain(gt - G, ht - H, right, l2) - _gain(gt, ht, np.clip(gt / (ht + l2), lo, hi), l2)
                gain[(N < least) | (nt - N < least) | (sign[:, None] * (right - left) < 0)] = -np.inf
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] > 1e-6 and b < len(edges[f]):
                    best = f, edges[f][b], left[f, b], right[f, b]
            if best is None:
                node[rows] = 2 * i + 1
                continue
            f, cut, a, b = best
            out.feature[t, i], out.threshold[t, i] = f, cut
            node[rows] = 2 * i + 1 + (x[rows, f] > cut)
            if sign[f]:
                middle = (a + b) / 2
                (high if sign[f] > 0 else low)[2 * i + 1] = middle
                (low if sign[f] > 0 else high)[2 * i + 2] = middle
        leaf = node - inner
        G, H = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        bounds = np.array([(low[inner + j], high[inner + j]) for j in range(inner + 1)])
        out.value[t] = rate * np.clip(G / (H + l2), bounds[:, 0], bounds[:, 1])
        score += out.value[t][leaf]
    return out


def _gain(g, h, v, l2):
    return 2 * g * v - (h + l2) * v * v
