"""Gradient-boosted trees for a yes-or-no label in numpy: logistic loss, histogram splits, trees of one depth."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0) -> dict:
    """x float (n, k), y 0/1 -> model; the same rows give the same model."""
    edges = [_edges(c, bins) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n, k = x.shape
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(n, base)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        size = 2**depth - 1
        feature, cut = np.zeros(size, np.int32), np.full(size, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            for f in range(k):
                if not len(edges[f]):
                    continue
                cells = local * (bins + 1) + binned[:, f]
                g = np.bincount(cells, grad, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(cells, hess, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain = np.where((h > 1e-3) & (ht - h > 1e-3), gain, 0)[:, : len(edges[f])]
                b = gain.argmax(axis=1)
                v = gain[np.arange(width), b]
                for node in np.flatnonzero(v > best):
                    best[node] = v[node]
                    feature[first + node], cut[first + node] = f, edges[f][b[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] >= cut[at])
        leaf = at - size
        g, h = (np.bincount(leaf, w, 2**depth) for w in (grad, hess))
        value = -rate * g / (h + ridge)
        score += value[leaf]
        trees.append((feature, cut, value))
    return {"base": base, "depth": depth, "trees": trees}


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Between all values where they are few (so that a rare flag can split too), else at quantiles."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def raw(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of label 1."""
    out, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, cut, value in model["trees"]:
        at = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
        out += value[at - len(feature)]
    return out
