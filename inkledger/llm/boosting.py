"""Gradient-boosted trees for yes/no labels, on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth under the logistic loss. A tree is its splits in heap order and its leaves' values."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, smooth: float = 2.0, share: float = 0.4, seed: int = 1):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth
        self.share, self.seed = share, seed
        self.base = 0.0
        self.features = np.zeros((0, 1 << depth), dtype=np.int32)
        self.limits = np.zeros((0, 1 << depth))
        self.leaves = np.zeros((0, 1 << depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        # A row per feature, so that each is read in one go.
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)
        useful = [f for f in range(width) if len(cuts[f])]
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        margin = np.full(n, self.base)
        features, limits, leaves = [], [], []
        draw = np.random.default_rng(self.seed)
        limits_of = [np.append(c, np.inf) for c in cuts]
        for _ in range(self.rounds):
            # Each tree is grown on a share of the rows.
            drawn = np.flatnonzero(draw.random(len(y)) < self.share)
            bins, n = binned[:, drawn], len(drawn)
            p = 1 / (1 + np.exp(-margin[drawn]))
            slope, bend = y[drawn] - p, p * (1 - p)
            at = np.ones(n, dtype=np.int64)
            feature = np.zeros(1 << self.depth, dtype=np.int32)
            split_at = np.full(1 << self.depth, self.bins, dtype=np.int64)
            for level in range(self.depth):
                first = 1 << level
                node = at - first
                best = np.full(first, 1e-9)
                split = np.full(first, -1)
                for f in useful:
                    size = len(cuts[f]) + 1
                    cell = node * size + bins[f]
                    g = np.bincount(cell, slope, first * size).reshape(first, size).cumsum(axis=1)
                    h = np.bincount(cell, bend, first * size).reshape(first, size).cumsum(axis=1)
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + self.smooth) + (gt - gl) ** 2 / (ht - hl + self.smooth) - gt**2 / (ht + self.smooth)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(first), k]
                    better = top > best
                    best[better] = top[better]
                    split[better] = k[better]
                    feature[first : 2 * first][better] = f
                split_at[first : 2 * first] = np.where(split >= 0, split, self.bins)
                at = 2 * at + (bins[feature[at], np.arange(n)] > split_at[at])
            leaf = at - (1 << self.depth)
            value = self.rate * np.bincount(leaf, slope, 1 << self.depth) / (np.bincount(leaf, bend, 1 << self.depth) + self.smooth)
            limit = np.array([np.inf if k >= len(limits_of[f]) else limits_of[f][k] for f, k in zip(feature.tolist(), split_at.tolist(), strict=True)])
            margin += value[_leaf(x, feature, limit, self.depth)]
            features.append(feature)
            limits.append(limit)
            leaves.append(value)
        self.features, self.limits, self.leaves = np.array(features), np.array(limits), np.array(leaves)
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        for feature, limit, value in zip(self.features, self.limits, self.leaves, strict=True):
            out += value[_leaf(x, feature, limit, self.depth)]
        return out


def _leaf(x: np.ndarray, feature: np.ndarray, limit: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each row in a tree."""
    rows, at = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
    for _ in range(depth):
        at = 2 * at + (x[rows, feature[at]] > limit[at])
    return at - (1 << depth)
