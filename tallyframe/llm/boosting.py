"""Gradient-boosted trees in numpy: logistic loss, few features, small samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of ``depth`` splits a path; each split is the best of up to 16 quantiles of each feature."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8, shrink: float = 1.0):
        self.trees, self.depth, self.rate, self.least, self.shrink = trees, depth, rate, least, shrink
        self.start, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 16), method="lower")) for j in range(x.shape[1])]
        share = y.mean()
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.nodes.append(tree)
            margin += self._value(tree, x)
        return self

    def _leaf(self, g: np.ndarray, h: np.ndarray) -> float:
        return self.rate * float(g.sum() / (h.sum() + self.shrink))

    def _grow(self, x, g, h, rows, cuts, depth):
        gs, hs = g[rows], h[rows]
        best = (1e-9, None, None)
        base = gs.sum() ** 2 / (hs.sum() + self.shrink)
        if depth and len(rows) >= 2 * self.least:
            for j, values in enumerate(cuts):
                column = x[rows, j]
                for cut in values:
                    low = column <= cut
                    n = int(low.sum())
                    if min(n, len(rows) - n) >= self.least:
                        gl, hl = gs[low].sum(), hs[low].sum()
                        gain = gl**2 / (hl + self.shrink) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + self.shrink) - base
                        if gain > best[0]:
                            best = (gain, j, cut)
        if best[1] is None:
            return self._leaf(gs, hs)
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[low], cuts, depth - 1), self._grow(x, g, h, rows[~low], cuts, depth - 1)

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._value(low, x), self._value(high, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        for tree in self.nodes:
            margin += self._value(tree, x)
        return 1 / (1 + np.exp(-margin))
