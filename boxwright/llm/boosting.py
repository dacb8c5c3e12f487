"""Gradient-boosted trees for a yes/no label, in NumPy: histogram splits, fixed depth, logistic loss."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, smooth: float = 2.0):
        self.n_trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = np.log(share / (1 - share))
        score = np.full(n, self.base)
        self.feature, self.bound, self.value = [], [], []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, bound = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                width = 2**level
                best = np.full(width, 1e-9)
                pick = [(0, np.inf)] * width
                for j in range(m):
                    k = len(self.edges[j]) + 1
                    if k < 2:
                        continue
                    cell = node * k + binned[:, j]
                    gs = np.bincount(cell, g, width * k).reshape(width, k).cumsum(1)
                    hs = np.bincount(cell, h, width * k).reshape(width, k).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    s = self.smooth
                    gain = (gs**2 / (hs + s) + (gt - gs) ** 2 / (ht - hs + s) - gt**2 / (ht + s))[:, :-1]
                    at = gain.argmax(1)
                    for v in np.flatnonzero(gain[np.arange(width), at] > best):
                        best[v], pick[v] = gain[v, at[v]], (j, float(self.edges[j][at[v]]))
                for v, (j, t) in enumerate(pick):
                    feature[width - 1 + v], bound[width - 1 + v] = j, t
                node = 2 * node + (x[np.arange(n), feature[width - 1 + node]] > bound[width - 1 + node])
            value = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.smooth)
            score += value[node]
            self.feature.append(feature)
            self.bound.append(bound)
            self.value.append(value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        n = len(x)
        out, rows = np.full(n, self.base), np.arange(n)
        for feature, bound, value in zip(self.feature, self.bound, self.value, strict=True):
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > bound[at])
            out += value[node]
        return out
