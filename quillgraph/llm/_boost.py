"""Gradient-boosted trees for a yes or no label: logistic loss, small trees over binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: node i has children 2i + 1 and 2i + 2; a row goes right where its feature passes the cut."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), int)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out


def _chances(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Newton steps: each tree's cuts gain most in squared gradient over curvature, by histograms of the bins."""
    y = y.astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
    margin = np.full(len(x), start := float(np.log(share / (1 - share))))
    inner = (1 << depth) - 1
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = _chances(margin)
        g, h = y - p, p * (1 - p)
        at, feature, limit = np.zeros(len(x), int), np.zeros(inner, int), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows) > 1:
                cells = flat[rows].ravel()
                gs, hs = (np.bincount(cells, np.repeat(v[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                j, b = divmod(int(np.argmax(gain)), width)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    feature[node], limit[node] = j, cuts[j][b]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
        sums = (np.bincount(at - inner, v, inner + 1) for v in (g, h))
        leaf = rate * (lambda a, b: a / (b + l2))(*sums)
        margin += leaf[at - inner]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(limits), np.array(leaves), start)


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic calibration: (margins ascending, chance from each on), by pooling neighbours that fall. A step lies halfway between two rows."""
    order = np.argsort(margins, kind="stable")
    m = margins[order]
    pools: list[list[float]] = []  # first row, sum, rows
    for i, v in enumerate(y[order].astype(float)):
        pools.append([i, v, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, total, n = pools.pop()
            pools[-1][1] += total
            pools[-1][2] += n
    return np.array([(m[p[0]] + m[max(p[0] - 1, 0)]) / 2 for p in pools]), np.array([p[1] / p[2] for p in pools])


def chances(margins: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    from_, chance = table
    if not len(from_):
        return np.zeros(len(margins))
    return np.where(margins < from_[0], 0.0, chance[np.maximum(np.searchsorted(from_, margins, side="right") - 1, 0)])
