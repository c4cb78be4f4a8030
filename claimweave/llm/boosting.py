"""Small gradient-boosted regression trees on arrays: squared loss (Huber loss with ``clip``), histogram splits."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth over binned features; every tree is kept as flat arrays.

    Fitting needs (rows x features) floats on one machine, so callers bound the rows.
    Constant targets or features give a constant prediction.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 20, clip: float = np.inf):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.clip = rounds, depth, rate, bins, least, clip

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        code = self._bin(x)
        self.base = float(y.mean()) if len(y) else 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out = np.full(len(y), self.base)
        for _ in range(self.rounds):
            tree = self._grow(code, np.clip(y - out, -self.clip, self.clip))
            self.trees.append(tree)
            out += self.rate * self._apply(tree, code)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, col, side="right") for e, col in zip(self.edges, x.T)], 1).astype(np.int16)

    def _grow(self, code: np.ndarray, r: np.ndarray):
        nodes = 2 ** (self.depth + 1)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        where = np.ones(len(r), int)
        for node in range(1, nodes):
            rows = np.flatnonzero(where == node)
            if not len(rows):
                continue
            value[node] = r[rows].mean()
            if node >= nodes // 2 or len(rows) < 2 * self.least:
                continue
            best = 1e-12
            total, n = r[rows].sum(), len(rows)
            for f in range(code.shape[1]):
                c = code[rows, f]
                k = int(c.max(initial=0)) + 1
                s, m = np.bincount(c, r[rows], k).cumsum()[:-1], np.bincount(c, minlength=k).cumsum()[:-1]
                ok = (m >= self.least) & (n - m >= self.least)
                if not ok.any():
                    continue
                gain = np.where(ok, s**2 / np.maximum(m, 1) + (total - s) ** 2 / np.maximum(n - m, 1) - total**2 / n, 0)
                if gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), f, int(gain.argmax())
            if feature[node] >= 0:
                where[rows] = 2 * node + (code[rows, feature[node]] > cut[node])
        return feature, cut, value

    def _apply(self, tree, code: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.ones(len(code), int)
        rows = np.arange(len(code))
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            at = np.where(go, 2 * at + (code[rows, np.maximum(f, 0)] > cut[at]), at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        code = self._bin(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._apply(tree, code)
        return out
