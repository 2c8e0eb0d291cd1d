"""Gradient-boosted trees over dense features with isotonic calibration, in numpy, for bounded training sets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Tree:
    """A complete tree: node k has children 2k + 1 and 2k + 2; a node without a split sends all rows left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(at) and at[0] < len(self.feature):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.threshold[at])
        return self.value[at - len(self.feature)]


@dataclass
class Boosted:
    """Logistic boosting on binned features; second-order leaf values with an L2 penalty."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    penalty: float = 2.0
    smallest_leaf: int = 8
    bins: int = 32
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.start, self.trees = float(np.log(mean / (1 - mean))), []
        if not len(y):
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = sigmoid(score)
            tree = self._grow(binned, edges, y - p, p * (1 - p))
            score += tree(x)
            self.trees.append(tree)
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> Tree:
        inner = 2**self.depth - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(gradient), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = self._split(binned[rows], gradient[rows], weight[rows]) if len(rows) >= 2 * self.smallest_leaf else None
            if best:
                feature[node], cut = best
                threshold[node] = edges[best[0]][cut]
                at[rows] = 2 * node + 1 + (binned[rows, best[0]] > cut)
            else:
                at[rows] = 2 * node + 1
        leaf = at - inner
        g, h = (np.bincount(leaf, v, inner + 1) for v in (gradient, weight))
        return Tree(feature, threshold, self.rate * g / (h + self.penalty))

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        total_g, total_h, best, gain = g.sum(), h.sum(), None, 1e-6
        base = total_g**2 / (total_h + self.penalty)
        for j in range(binned.shape[1]):
            sums = [np.cumsum(np.bincount(binned[:, j], v, self.bins))[:-1] for v in (g, h, np.ones_like(g))]
            left = sums[0] ** 2 / (sums[1] + self.penalty)
            right = (total_g - sums[0]) ** 2 / (total_h - sums[1] + self.penalty)
            gains = np.where((sums[2] >= self.smallest_leaf) & (len(g) - sums[2] >= self.smallest_leaf), left + right - base, 0)
            k = int(gains.argmax())
            if gains[k] > gain:
                best, gain = (j, k), gains[k]
        return best

    def __call__(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += tree(x)
        return score


@dataclass
class Isotonic:
    """Pool-adjacent-violators fit of label on score, interpolated between the pooled steps."""

    x: np.ndarray = field(default_factory=lambda: np.zeros(1))
    y: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def fit(self, score: np.ndarray, label: np.ndarray) -> Isotonic:
        if not len(score):
            return self
        blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
        for s, v in sorted(zip(score.tolist(), label.tolist(), strict=True)):
            blocks.append([v, 1, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        # half a row of either label keeps the ends off 0 and 1
        self.x = np.asarray([b[2] / b[1] for b in blocks])
        self.y = np.maximum.accumulate([(b[0] + 0.5 * label.mean()) / (b[1] + 0.5) for b in blocks])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
