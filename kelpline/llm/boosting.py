"""A small gradient-boosted tree classifier (logistic loss, histogram splits) in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees on binned features; trained on the driver from a bounded sample."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.edges: list[np.ndarray] = []
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self._stacked = None

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        out = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-out))
            g, h = y - p, p * (1 - p)
            nodes = 2 ** (self.depth + 1) - 1
            feat, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = self.rate * gs / (hs + self.l2)
                if node >= 2**self.depth - 1 or len(rows) < 8:
                    continue
                best, found = 1e-3, None
                for j in range(b.shape[1]):
                    n = len(self.edges[j]) + 1
                    if n < 2:
                        continue
                    gl = np.cumsum(np.bincount(b[rows, j], g[rows], n))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, j], h[rows], n))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, found = gain[k], (j, k)
                if found:
                    feat[node], cut[node] = found
                    right = b[rows, found[0]] > found[1]
                    at[rows] = 2 * node + 1 + right
            self.forest.append((feat, cut, value))
            out += self._tree(b, self.forest[-1])
        return self

    @staticmethod
    def _tree(b: np.ndarray, tree) -> np.ndarray:
        feat, cut, value = tree
        at = np.zeros(len(b), np.int64)
        while True:
            f = feat[at]
            inner = f >= 0
            if not inner.any():
                return value[at]
            rows = np.flatnonzero(inner)
            at[rows] = 2 * at[rows] + 1 + (b[rows, f[rows]] > cut[at[rows]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row; all trees walk down together."""
        if not len(x):
            return np.zeros(0)
        out = np.full(len(x), self.base)
        if self.forest:
            if self._stacked is None:
                self._stacked = tuple(np.stack(parts) for parts in zip(*self.forest))
            feat, cut, value = self._stacked
            tree = np.arange(len(self.forest))[None, :]
            for a in range(0, len(x), 4096):
                b = self._bin(x[a : a + 4096])
                row = np.arange(len(b))[:, None]
                at = np.zeros((len(b), len(self.forest)), np.int64)
                for _ in range(self.depth):
                    f = feat[tree, at]
                    at = np.where(f >= 0, 2 * at + 1 + (b[row, f] > cut[tree, at]), at)
                out[a : a + 4096] += value[tree, at].sum(axis=1)
        return 1 / (1 + np.exp(-out))
