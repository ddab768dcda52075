"""Gradient-boosted regression trees for two classes, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Complete binary trees of equal depth; ``edges`` cut features into bins."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, least: float = 2.0):
        self.n_trees, self.depth, self.rate, self.least = trees, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x = x.astype(np.float32)
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], grid)) for f in range(x.shape[1])]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        self.feature = np.zeros((self.n_trees, 2**self.depth - 1), np.int64)
        self.cut = np.full((self.n_trees, 2**self.depth - 1), BINS, np.int64)
        self.leaf = np.zeros((self.n_trees, 2**self.depth))
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            self._grow(t, binned, y - p, p * (1 - p))
            score += self._leaves(t, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def _grow(self, t: int, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        node = np.zeros(len(g), np.int64)
        features = binned.shape[1]
        for level in range(self.depth):
            width, first = 2**level, 2**level - 1
            size = width * BINS
            best = np.full(width, 1e-9)
            for f in range(features):
                key = node * BINS + binned[:, f]
                sums = [np.bincount(key, v, minlength=size).reshape(width, BINS).cumsum(axis=1) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                self.feature[t, first : first + width][better] = f
                self.cut[t, first : first + width][better] = at[better]
            here = first + node
            right = binned[np.arange(len(g)), self.feature[t, here]] > self.cut[t, here]
            node = node * 2 + right
        n = 2**self.depth
        self.leaf[t] = self.rate * np.bincount(node, g, minlength=n) / (np.bincount(node, h, minlength=n) + 1)

    def _leaves(self, t: int, binned: np.ndarray) -> np.ndarray:
        rows, node = np.arange(len(binned)), np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            here = 2**level - 1 + node
            node = node * 2 + (binned[rows, self.feature[t, here]] > self.cut[t, here])
        return self.leaf[t, node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x.astype(np.float32))
        return self.start + sum(self._leaves(t, binned) for t in range(self.n_trees))
