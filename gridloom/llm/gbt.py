"""Gradient-boosted trees for a logistic loss, small enough to be fitted on the driver, and isotonic calibration."""

from __future__ import annotations

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class BoostedTrees:
    """Complete trees of one depth: ``feature`` and ``threshold`` by node, ``leaf`` values left to right."""

    def __init__(self, base: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.trees = base, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> BoostedTrees:
        """No rows, or rows of one class, give a model that always says that class's smoothed rate."""
        n, width = x.shape
        rate_of_ones = (y.sum() + 1.0) / (n + 2.0)
        base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
        if n == 0 or y.min() == y.max():
            return cls(base, [])
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
        score, grown = np.full(n, base), []
        for _ in range(trees):
            p = _sigmoid(score)
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            features, thresholds = [], []
            for level in range(depth):
                size = 1 << level
                best = np.full(size, 1e-9)
                pick, cut = np.zeros(size, dtype=np.int64), np.full(size, np.inf)
                where = np.full(size, bins)
                total_g, total_h = np.bincount(node, g, size), np.bincount(node, h, size)
                for j in range(width):
                    if not len(cuts[j]):
                        continue
                    at = node * bins + code[:, j]
                    left_g = np.bincount(at, g, size * bins).reshape(size, bins).cumsum(axis=1)[:, : len(cuts[j])]
                    left_h = np.bincount(at, h, size * bins).reshape(size, bins).cumsum(axis=1)[:, : len(cuts[j])]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                    gain[(left_h < least * 0.1) | (right_h < least * 0.1)] = 0
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(size), k] > best
                    best[better], pick[better], where[better] = gain[np.arange(size), k][better], j, k[better]
                    cut[better] = cuts[j][k[better]]
                features.append(pick)
                thresholds.append(cut)
                node = node * 2 + (code[np.arange(n), pick[node]] > where[node])
            leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
            score += leaf[node]
            grown.append((np.concatenate(features), np.concatenate(thresholds), leaf))
        return cls(base, grown)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node, first, size = np.zeros(len(x), dtype=np.int64), 0, 1
            while first < len(feature):
                at = first + node
                node = node * 2 + (x[rows, feature[at]] > threshold[at])
                first, size = first + size, size * 2
            out += leaf[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.score(x))

    def sql(self, names: list[str]) -> str:
        """The score as one SQL expression over feature expressions."""

        def branch(tree: tuple, level: int, node: int) -> str:
            feature, threshold, leaf = tree
            at = (1 << level) - 1 + node
            if at >= len(feature):
                return f"{leaf[node]:.9g}D"
            if np.isinf(threshold[at]):
                return branch(tree, level + 1, node * 2)
            low, high = branch(tree, level + 1, node * 2), branch(tree, level + 1, node * 2 + 1)
            return low if low == high else f"IF({names[feature[at]]} <= {threshold[at]:.17g}D, {low}, {high})"

        return " + ".join([f"{self.base:.9g}D", *(branch(t, 0, 0) for t in self.trees)])


def isotonic(score: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing map from score to probability: adjacent violators are pooled.

    Each pool has its first and its last score as knots, so that the map is flat
    within it and rises only between pools.
    """
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    names, place, times = np.unique(score, return_inverse=True, return_counts=True)  # one score has one value
    values, weights, first, last = [], [], [], []
    for s, v, w in zip(names.tolist(), (np.bincount(place, y) / times).tolist(), times.tolist(), strict=True):
        values.append(v), weights.append(float(w)), first.append(s), last.append(s)
        while len(values) > 1 and values[-2] >= values[-1]:
            v, w, end = values.pop(), weights.pop(), last.pop()
            first.pop()
            values[-1] = (values[-1] * weights[-1] + v * w) / (weights[-1] + w)
            weights[-1] += w
            last[-1] = end
    rate = float(y.mean())
    smooth = np.maximum.accumulate([(v * w + prior * rate) / (w + prior) for v, w in zip(values, weights, strict=True)])
    knots = np.stack([first, last], axis=1).ravel()
    keep = np.append(True, np.diff(knots) > 0)  # a pool of one score has one knot
    return knots[keep], np.repeat(smooth, 2)[keep]


def calibrated(score: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.interp(score, knots, values)
