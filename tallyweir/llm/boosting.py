"""Gradient-boosted trees for a logistic loss on a few numeric features, in numpy, for bounded training samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on feature quantiles, fitted by Newton steps; ``predict`` gives log-odds."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0, leaf: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.leaf = rounds, depth, rate, bins, ridge, leaf
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        # cuts at quantiles and, for features with a gap, at even steps
        inner = np.linspace(0, 1, self.bins + 1)[1:-1]
        edges = [np.unique(np.concatenate([np.quantile(x[:, j], inner), x[:, j].min() + inner * np.ptp(x[:, j])])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        odds = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-odds))
            tree = self._grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            odds += self.rate * self._apply(tree, x)
        return self

    def _grow(self, binned, edges, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        if depth and len(rows) > 1:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + self.ridge) + (gs - left_g) ** 2 / (hs - left_h + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(left_h < self.leaf * 0.05) | (hs - left_h < self.leaf * 0.05)] = -1
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k)
        if best is None:
            return float(-gs / (hs + self.ridge))
        _, j, k = best
        goes = binned[rows, j] <= k
        return (j, float(edges[j][k]), self._grow(binned, edges, g, h, rows[goes], depth - 1), self._grow(binned, edges, g, h, rows[~goes], depth - 1))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        goes = x[:, j] <= cut
        out = np.empty(len(x))
        out[goes], out[~goes] = self._apply(low, x[goes]), self._apply(high, x[~goes])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.base)
        for tree in self.trees:
            odds += self.rate * self._apply(tree, x)
        return odds


def platt(odds: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> tuple[float, float]:
    """(slope, offset) that calibrate log-odds; drawn towards no change where the cases are few."""
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * odds + offset, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - y) * odds).sum() + ridge * (slope - 1), (p - y).sum() + ridge * offset])
        h = np.array([[(w * odds * odds).sum() + ridge, (w * odds).sum()], [(w * odds).sum(), w.sum() + ridge]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)
