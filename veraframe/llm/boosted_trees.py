"""Gradient-boosted decision trees for binary labels: logistic loss, histogram splits, complete trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """``feature`` and ``threshold`` are (trees, 2**depth - 1), ``leaf`` is (trees, 2**depth); scores are log-odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
    """Newton boosting. With one class only, the model is that class's constant."""
    weight = np.ones(len(y)) if weight is None else weight
    share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else []
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, 0), int)
    n_features, inner = codes.shape[1], 2**depth - 1
    score = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = at - first
            gain, best_f, best_b = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, np.int64)
            for j in range(n_features):
                cell = slot * bins + codes[:, j]
                gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                got = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                got[:, len(edges[j]) :] = 0  # nothing is right of the last edge
                b = got.argmax(1)
                better = got[np.arange(width), b] > gain
                gain[better], best_f[better], best_b[better] = got[np.arange(width), b][better], j, b[better]
            for s in np.flatnonzero(best_f >= 0):
                f[first + s], t[first + s] = best_f[s], edges[best_f[s]][best_b[s]]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > t[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[leaf]
        features.append(f), thresholds.append(t), leaves.append(value)
    shape = (len(features), inner)
    return BoostedTrees(base, np.array(features).reshape(shape), np.array(thresholds).reshape(shape), np.array(leaves).reshape(len(features), inner + 1))
