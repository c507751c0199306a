"""Gradient-boosted trees on histograms, flattened into arrays for whole-batch traversal."""

from __future__ import annotations

import numpy as np

DEPTH, ROUNDS, RATE, BINS, LEAST, RIDGE = 4, 60, 0.15, 64, 20, 1.0


def cut_points(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Values between which each feature falls into bins of about equal size."""
    return [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in x.T] if len(x) else [np.zeros(0)] * x.shape[1]


class Trees:
    """Full binary trees in level order: node i has children 2i + 1 and 2i + 2.

    A node sends a row right if ``row[feature] > threshold``; one that was not split has an
    infinite threshold. ``values`` has the leaves' sums in order.
    """

    def __init__(self, base: float, features: np.ndarray, thresholds: np.ndarray, values: np.ndarray):
        self.base, self.features, self.thresholds, self.values = base, features, thresholds, values

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(self.values.shape[1]).bit_length() - 1 if len(self.values) else 0
        for feature, threshold, value in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Trees for labels 0 and 1 under the logistic loss, by second-order gains.

    With no rows, or one label only, the result is the smoothed share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    n_inner, n_leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, n_inner), np.int64), np.zeros((0, n_inner)), np.zeros((0, n_leaves)))
    cuts = cut_points(x)
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], axis=1)
    total = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f in range(x.shape[1]):
                key = (node - first) * BINS + binned[:, f]
                sums = [np.bincount(key, w, width * BINS).reshape(width, BINS) for w in (g, h, np.ones(len(y)))]
                left = [s.cumsum(axis=1)[:, :-1] for s in sums]
                right = [s.sum(axis=1, keepdims=True) - left_ for s, left_ in zip(sums, left)]
                gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE)
                gain -= sums[0].sum(axis=1, keepdims=True) ** 2 / (sums[1].sum(axis=1, keepdims=True) + RIDGE)
                gain[(left[2] < LEAST) | (right[2] < LEAST)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                for k in np.flatnonzero(value > best):
                    best[k] = value[k]
                    feature[first + k], threshold[first + k] = f, cuts[f][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - n_inner
        sums = [np.bincount(leaf, w, n_leaves) for w in (g, h)]
        value = rate * sums[0] / (sums[1] + RIDGE)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))
