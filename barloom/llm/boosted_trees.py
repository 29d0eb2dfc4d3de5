"""Gradient-boosted regression trees for a logistic loss, on a bounded in-memory sample."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    """Complete binary trees of one depth: per tree and inner node a feature and a threshold, per leaf a value."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the positive class."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while (inner := node[0] if len(node) else len(feature)) < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, least: float = 2.0) -> Forest:
    """Boosted trees of fixed depth; splits maximise the second-order gain over quantile bins."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    total = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            own = node - first
            best = np.full(count, 1e-9)
            sums = [np.bincount(own, w, count) for w in (g, h)]
            whole = sums[0] ** 2 / (sums[1] + 1)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                cells = own * (bins + 1) + binned[:, f]
                left = [np.cumsum(np.bincount(cells, w, count * (bins + 1)).reshape(count, bins + 1), axis=1)[:, : len(cuts[f])] for w in (g, h)]
                right = [s[:, None] - a for s, a in zip(sums, left)]
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - whole[:, None]
                gain[(left[1] < least / 10) | (right[1] < least / 10)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                features[t, first : first + count][better] = f
                thresholds[t, first : first + count][better] = cuts[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        total += values[t, leaf]
    return Forest(features, thresholds, values, base)
