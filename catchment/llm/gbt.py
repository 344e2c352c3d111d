"""Histogram gradient-boosted trees for two classes, as flat arrays.

All trees have the same depth and are stored as complete binary trees: ``feature`` and
``threshold`` by inner node, ``leaf`` by leaf.  A batch of rows walks all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    depth: int
    start: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        n, trees = len(x), len(self.leaf)
        z = np.full(n, self.start)
        if n and trees:
            at = np.zeros((n, trees), np.int64)
            tree, row = np.arange(trees)[None, :], np.arange(n)[:, None]
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
            z = z + self.leaf[tree, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _bins(x: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers of every value, and the upper borders of the bins of each feature."""
    borders, out = [], np.zeros(x.shape, np.int64)
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, most + 1)[1:-1]))
        q = q[q < x[:, f].max()] if len(x) else q
        borders.append(q)
        out[:, f] = np.searchsorted(q, x[:, f], "left")
    return out, borders


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, min_rows: float = 8) -> Forest:
    """Logistic loss, second-order gains.  The same data give the same forest."""
    n, inner = len(x), 2**depth - 1
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Forest(depth, start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    binned, borders = _bins(x, bins)
    width, n_feat = bins + 1, x.shape[1]
    flat = binned + np.arange(n_feat) * width
    z = np.full(n, start)
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)  # node within its level
        f_tree, t_tree = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes = 2**level
            slot = (at[:, None] * (n_feat * width) + flat).ravel()
            size = nodes * n_feat * width
            sums = [np.bincount(slot, np.repeat(v, n_feat), size).reshape(nodes, n_feat, width).cumsum(axis=2) for v in (g, h, np.ones(n))]
            left, total = [s[:, :, :-1] for s in sums], [s[:, :, -1:] for s in sums]
            right = [t - v for t, v in zip(total, left)]
            score = lambda s: s[0] ** 2 / (s[1] + ridge)
            gain = np.where((left[2] >= min_rows) & (right[2] >= min_rows), score(left) + score(right) - score(total), 0)
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), width - 1)
                if gain[k, f, b] > 1e-6 and b < len(borders[f]):
                    f_tree[nodes - 1 + k], t_tree[nodes - 1 + k] = f, borders[f][b]
            node = nodes - 1 + at
            at = 2 * at + (x[np.arange(n), f_tree[node]] > t_tree[node])
        weight = -np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge) * rate
        z += weight[at]
        feature.append(f_tree), threshold.append(t_tree), leaf.append(weight)
    return Forest(depth, start, np.array(feature), np.array(threshold), np.array(leaf))
