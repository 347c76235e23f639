"""Gradient-boosted trees for several classes, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting with complete trees of a fixed depth over quantile bins."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge = classes, rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, n_features = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(n_features)]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        margin, one_hot = np.zeros((n, self.classes)), np.eye(self.classes)[y]
        self.trees = []
        for _ in range(self.rounds):
            p = softmax(margin)
            for k in range(self.classes):
                tree, at = self._grow(binned, edges, p[:, k] - one_hot[:, k], p[:, k] * (1 - p[:, k]) + 1e-6)
                self.trees.append(tree)
                margin[:, k] += tree[2][at]
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray):
        inner = 2**self.depth - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            gain, best_f, best_b = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cells = local * (len(e) + 1) + binned[:, f]
                sums = [np.bincount(cells, v, minlength=width * (len(e) + 1)).reshape(width, -1) for v in (g, h)]
                (gl, hl), (gt, ht) = [np.cumsum(s, axis=1)[:, :-1] for s in sums], [s.sum(axis=1, keepdims=True) for s in sums]
                score = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                b = score.argmax(axis=1)
                top = score[np.arange(width), b]
                better = top > gain
                gain[better], best_f[better], best_b[better] = top[better], f, b[better]
            right = np.zeros(len(g), bool)
            for j in np.flatnonzero(best_b >= 0):
                feature[first + j], threshold[first + j] = best_f[j], edges[best_f[j]][best_b[j]]
                mine = local == j
                right[mine] = binned[mine, best_f[j]] > best_b[j]
            node = 2 * node + 1 + right
        leaf = node - inner
        total = [np.bincount(leaf, v, minlength=inner + 1) for v in (g, h)]
        return (feature, threshold, -self.rate * total[0] / (total[1] + self.ridge)), leaf

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.zeros((len(x), self.classes)), np.arange(len(x))
        for t, (feature, threshold, value) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            margin[:, t % self.classes] += value[at - len(feature)]
        return np.log(softmax(margin) + 1e-9)


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
