"""Small gradient boosted trees for two classes, on a bounded table of numbers."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0) -> dict[str, np.ndarray]:
    """Trees of the given depth under the logistic loss, with splits at quantiles of each feature.

    Returns plain arrays: first (log odds), feature and cut per inner node and tree
    (complete binary trees, level by level), leaf values.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    place = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, width), int)
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    first = np.log(share / (1 - share))
    score = np.full(n, first)
    feature = np.zeros((trees, 2**depth - 1), np.int64)
    cut = np.full((trees, 2**depth - 1), np.inf)
    leaf = np.zeros((trees, 2**depth))
    for k in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            chosen = np.full(count, -1)
            at = np.zeros(count, np.int64)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = node * (len(c) + 1) + place[:, j]
                g = np.bincount(key, slope, count * (len(c) + 1)).reshape(count, -1).cumsum(axis=1)
                h = np.bincount(key, bend, count * (len(c) + 1)).reshape(count, -1).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                left, right = h[:, :-1], ht - h[:, :-1]
                gain = g[:, :-1] ** 2 / (left + 1) + (gt - g[:, :-1]) ** 2 / (right + 1) - gt**2 / (ht + 1)
                gain[(left < least) | (right < least)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(count), top]
                better = value > best
                best[better], chosen[better], at[better] = value[better], j, top[better]
            for i in np.flatnonzero(chosen >= 0):
                feature[k, base + i], cut[k, base + i] = chosen[i], cuts[chosen[i]][at[i]]
            node = 2 * node + (x[np.arange(n), feature[k, base + node]] > cut[k, base + node])
        g, h = np.bincount(node, slope, 2**depth), np.bincount(node, bend, 2**depth)
        leaf[k] = rate * g / (h + 1)
        score = score + leaf[k][node]
    return {"first": np.array(first), "feature": feature, "cut": cut, "leaf": leaf}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The probability of class 1 for each row."""
    rows = np.arange(len(x))
    score = np.full(len(x), float(model["first"]))
    depth = int(np.log2(model["leaf"].shape[1]))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, feature[at]] > cut[at])
        score += leaf[node]
    return 1 / (1 + np.exp(-score))
