"""Gradient-boosted decision trees for several classes, in NumPy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Softmax boosting: each round fits one small regression tree per class to the gradient."""

    def __init__(self, classes: int, rounds: int = 25, depth: int = 3, rate: float = 0.35, smooth: float = 1.0, bins: int = 16) -> None:
        self.classes, self.rounds, self.depth, self.rate, self.smooth, self.bins = classes, rounds, depth, rate, smooth, bins
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        cuts = [c if len(c) else np.zeros(1) for c in cuts]
        # cuts between values, so a cut at a value sends larger ones right
        b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        score, hot = np.zeros((len(x), self.classes)), np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            trees = []
            for k in range(self.classes):
                t = self._tree(b, cuts, hot[:, k] - p[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6))
                score[:, k] += self._apply(t, x)
                trees.append(t)
            self.trees.append(trees)
        return self

    def _tree(self, b: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """feature and threshold of each inner node (breadth first), value of each leaf."""
        inner = (1 << self.depth) - 1
        feature, limit, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(b), np.int64)
        wide = self.bins + 1
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            best = np.zeros(n)
            own = at - first
            total_g, total_h = np.bincount(own, g, n), np.bincount(own, h, n)
            base = total_g**2 / (total_h + self.smooth)
            for f in range(b.shape[1]):
                key = own * wide + b[:, f]
                lg = np.cumsum(np.bincount(key, g, n * wide).reshape(n, wide), 1)[:, : len(cuts[f])]
                lh = np.cumsum(np.bincount(key, h, n * wide).reshape(n, wide), 1)[:, : len(cuts[f])]
                rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                gain = lg**2 / (lh + self.smooth) + rg**2 / (rh + self.smooth) - base[:, None]
                c = gain.argmax(1)
                top = gain[np.arange(n), c]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i], feature[first + i], limit[first + i] = top[i], f, cuts[f][c[i]]
            go = b[np.arange(len(b)), feature[at]] > np.array([np.searchsorted(cuts[f], v, "left") if np.isfinite(v) else wide for f, v in zip(feature, limit, strict=True)])[at]
            at = 2 * at + 1 + go
        leaf = at - inner
        return feature, limit, self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.smooth)

    def _apply(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, limit, value = tree
        at, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[row, feature[at]] > limit[at])
        return value[at - len(feature)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities (n, classes)."""
        score = np.zeros((len(x), self.classes))
        for trees in self.trees:
            for k, t in enumerate(trees):
                score[:, k] += self._apply(t, x)
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))
