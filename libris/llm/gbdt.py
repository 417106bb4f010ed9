"""Gradient-boosted trees for a yes-or-no target, on histograms of features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i has the children 2 i + 1 and 2 i + 2.

    feature and threshold are (trees, inner nodes), value is (trees, leaves); a row
    goes right if its feature is over the threshold.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 5.0) -> Trees:
    """Newton boosting on the logistic loss.

    Every feature is cut at up to ``bins`` quantiles; a level's splits come from one
    histogram per node and feature.  A node that no split improves sends all rows left.
    """
    n, m = x.shape
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), np.int64)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            cut_of = np.full(width, -1)
            for f in range(m):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                key = local * size + code[:, f]
                gs = np.bincount(key, g, width * size).reshape(width, size).cumsum(axis=1)
                hs = np.bincount(key, h, width * size).reshape(width, size).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
                gain = np.where((hl >= least / 20) & (ha - hl >= least / 20), gain, -1)
                k = gain.argmax(axis=1)
                got = gain[np.arange(width), k]
                better = got > best
                best = np.where(better, got, best)
                cut_of = np.where(better, k, cut_of)
                feature[t, first : first + width][better] = f
            for i in np.flatnonzero(cut_of >= 0):
                threshold[t, first + i] = cuts[feature[t, first + i]][cut_of[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + penalty)
        margin += value[t][leaf]
    return Trees(base, feature, threshold, value)
