"""Gradient-boosted trees for binary labels on numpy arrays: binned features, trees of fixed depth, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: ``feature`` and ``cut`` by inner node (x <= cut goes left), ``leaf`` values, all in heap order."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.25, l2: float = 5.0) -> Trees:
    """Second-order boosting; each inner node takes the split of largest gain among the quantile cuts of all features."""
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    z = np.full(n, bias)
    inner = (1 << depth) - 1
    features, values, leaves = [], [], []
    flat = binned + np.arange(m) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            base, k = (1 << level) - 1, 1 << level
            place = ((at - base)[:, None] * (m * BINS) + flat).ravel()
            hg, hh = (np.bincount(place, np.repeat(v, m), k * m * BINS).reshape(k, m, BINS) for v in (g, h))
            lg, lh = hg.cumsum(axis=2), hh.cumsum(axis=2)
            tg, th = lg[:, :, -1:], lh[:, :, -1:]
            gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
            gain[(lh < 1e-3) | (th - lh < 1e-3)] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            for node in range(k):
                f, b = divmod(int(best[node]), BINS)
                if gain[node, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[base + node], cut[base + node] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        slot = at - inner
        leaf = rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + l2)
        z += leaf[slot]
        features.append(feature)
        values.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(values), np.array(leaves), bias)
