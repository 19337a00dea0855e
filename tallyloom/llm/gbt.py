"""Gradient-boosted trees for a binary label, on histograms of feature quantiles.

Cases: labels that are all equal give that label; a constant feature is never split; fit needs a row, predict none.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth: at each inner place a feature and a threshold, at each leaf a value."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        flat = binned + np.arange(x.shape[1]) * self.bins
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.threshold = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = np.log(share / (1 - share))
        score = np.full(len(y), self.start)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            place = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for node in range(first, 2 * first + 1):
                    own = np.flatnonzero(place == node)
                    if len(own) < 8:
                        continue
                    size = x.shape[1] * self.bins
                    cells = flat[own].ravel()
                    gs, hs = (np.bincount(cells, np.repeat(v[own], x.shape[1]), size).reshape(-1, self.bins).cumsum(1) for v in (g, h))
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
                    for f, e in enumerate(edges):
                        gain[f, len(e) :] = -1
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-6:
                        self.feature[t, node], self.threshold[t, node] = f, edges[f][b]
                on = (place >= first) & (place <= 2 * first)
                place[on] = 2 * place[on] + 1 + (x[on, self.feature[t, place[on]]] > self.threshold[t, place[on]])
            leaf = place - inner
            self.leaf[t] = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            score += self.leaf[t, leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            place = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                place = 2 * place + 1 + (x[rows, feature[place]] > threshold[place])
            score += leaf[place - len(feature)]
        return 1 / (1 + np.exp(-score))
