"""Histogram gradient-boosted trees for two classes, in numpy.

Trees are complete and of one depth, so a forest is four flat arrays and a row
moves down all of them by arithmetic on node numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """``feature`` and ``threshold``: a row per tree, a column per inner node in level order; ``leaf``: a column per leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row of ``x``."""
        n, depth = len(x), int(np.log2(self.leaf.shape[1]))
        out = np.full(n, self.base)
        rows = np.arange(n) * x.shape[1]
        flat = np.ascontiguousarray(x).reshape(-1)
        inner = self.leaf.shape[1] - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(n, np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (flat[rows + feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Forest:
    """Fits a forest to rows ``x`` and classes ``y`` of 0 and 1.

    With no rows or one class only, it is a forest without trees that returns the (smoothed) prior.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    inner, width = 2**depth - 1, x.shape[1] if x.ndim == 2 else 1
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin, features, thresholds, leaves = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            n, first = 2**level, 2**level - 1
            best, split_f, split_b = np.full(n, 1e-6), np.full(n, -1), np.zeros(n, np.int64)
            for f in range(width):
                key = node * bins + binned[:, f]
                gs = np.bincount(key, g, n * bins).reshape(n, bins).cumsum(1)
                hs = np.bincount(key, h, n * bins).reshape(n, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = -1
                gain[:, len(cuts[f]) :] = -1
                b = gain.argmax(1)
                top = gain[np.arange(n), b]
                better = top > best
                best[better], split_f[better], split_b[better] = top[better], f, b[better]
            for i in np.flatnonzero(split_f >= 0):
                feature[first + i], threshold[first + i] = split_f[i], cuts[split_f[i]][split_b[i]]
            f = np.maximum(split_f[node], 0)
            node = 2 * node + ((split_f[node] >= 0) & (binned[np.arange(len(y)), f] > split_b[node]))
        leaf = rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + l2)
        margin += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)
