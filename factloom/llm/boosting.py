"""Gradient-boosted trees of fixed depth for a logistic loss, in numpy, with Platt scaling."""

from __future__ import annotations

import numpy as np


class Boosting:
    """Binary classifier. Each tree is perfect: node k has children 2k+1 and 2k+2; feature -1 sends every row left."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, l2: float = 1.0):
        self.count, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.base, self.scale, self.shift = 0.0, 1.0, 0.0
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        share = y.mean()
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-margin))
            slope, bend = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full(inner, -1), np.zeros(inner)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                for f, e in enumerate(edges):
                    if not len(e) or not len(rows):
                        continue
                    b = binned[rows, f]
                    g, h = (np.bincount(b, v[rows], len(e) + 1).cumsum() for v in (slope, bend))
                    gain = g**2 / (h + self.l2) + (g[-1] - g) ** 2 / (h[-1] - h + self.l2) - g[-1] ** 2 / (h[-1] + self.l2)
                    at = int(gain[:-1].argmax())
                    if gain[at] > best:
                        best, feature[k], cut[k] = gain[at], f, e[at]
                go = x[rows, feature[k]] > cut[k] if feature[k] >= 0 else np.zeros(len(rows), bool)
                node[rows] = 2 * k + 1 + go
            leaf = node - inner
            value = np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + self.l2) * self.rate
            margin += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((feature[node] >= 0) & (x[rows, feature[node]] > cut[node]))
            total += value[node - (2**self.depth - 1)]
        return total

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        """Fit scale and shift of the margin to held-out rows by Newton steps."""
        m = np.stack([self.margin(x), np.ones(len(y))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
            w += np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2), m.T @ (y - p) - 1e-3 * (w - [1, 0]))
        self.scale, self.shift = float(w[0]), float(w[1])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) * self.scale + self.shift, -30, 30)))
