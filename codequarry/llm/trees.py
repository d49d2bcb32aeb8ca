"""Gradient-boosted trees on dense features, and isotonic calibration.

For training sets of bounded size that fit a task: histogram splits over quantile bins,
logistic loss, Newton leaves. Trees are complete and stored as arrays, so predicting is a
few gathers per level for a whole batch of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: ``feature`` and ``bound`` by tree and inner node, ``leaf``
    by tree and leaf. A row goes right where its feature is above the bound."""

    depth: int
    base: float
    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        out = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[each, feature[node]] > bound[node])
            out += leaf[node - len(feature)]
        return out


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2,
        bins: int = 32, ridge: float = 1.0, least: float = 1.0, weight: np.ndarray | None = None) -> Forest:
    """Boost ``trees`` trees on the logistic loss. Ties between splits go to the first feature
    and the lowest bound. A constant label gives trees that change nothing. ``weight`` is how
    many rows each row counts as, one by default."""
    n, width = rows.shape
    weight = np.ones(n) if weight is None else weight
    edges = []
    binned = np.zeros((n, width), np.int64)
    for f in range(width):
        cuts = np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0)
        edges.append(cuts)
        binned[:, f] = np.searchsorted(cuts, rows[:, f], side="left")
    rate_of_ones = np.clip(np.average(labels, weights=weight) if n else 0.5, 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    margin = np.full(n, base)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    features = np.zeros((trees, inner), np.int64)
    bounds = np.full((trees, inner), np.inf)
    values = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = weight * (p - labels), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            best = np.full(count, 1e-6)
            for f in range(width):
                size = len(edges[f]) + 1
                if size == 1:
                    continue
                cell = (node - first) * size + binned[:, f]
                g = np.cumsum(np.bincount(cell, gradient, count * size).reshape(count, size), axis=1)
                h = np.cumsum(np.bincount(cell, curve, count * size).reshape(count, size), axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                left_g, left_h = g[:, :-1], h[:, :-1]
                gain = (left_g ** 2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge)
                        - total_g ** 2 / (total_h + ridge))
                gain[(left_h < least) | (total_h - left_h < least)] = 0
                at = np.argmax(gain, axis=1)
                top = gain[np.arange(count), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                features[t, first + better] = f
                bounds[t, first + better] = edges[f][at[better]]
            node = 2 * node + 1 + (rows[np.arange(n), features[t, node]] > bounds[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, curve, leaves)
        values[t] = -rate * g / (h + ridge)
        margin += values[t][leaf]
    return Forest(depth, base, features, bounds, values)


@dataclass(frozen=True)
class Isotonic:
    """A rising step function through points, linear in between."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return 1 / (1 + np.exp(-margin))
        return np.interp(margin, self.at, self.value)


def isotonic(margin: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators: the best rising fit of ``labels`` over ``margin``, rows counted
    ``weight`` times.

    Equal margins are one point. Chances stay inside (0, 1) by one half of a pseudo-count."""
    if not len(margin):
        return Isotonic(np.zeros(0), np.zeros(0))
    at, which = np.unique(margin, return_inverse=True)
    weight = np.ones(len(margin)) if weight is None else weight
    ones, many = np.bincount(which, weight * labels), np.bincount(which, weight)
    blocks: list[list[float]] = []  # ones, rows, first and last point
    for i in range(len(at)):
        blocks.append([ones[i], many[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    value = [(b[0] + 0.5 * (b[0] > 0) - 0.5 * (b[0] == b[1]) + 0.25 * (b[0] == 0)) / (b[1] + 0.5) for b in blocks]
    value = np.maximum.accumulate(np.clip(value, 1e-6, 1 - 1e-6))
    points = [(at[int(b[k])], v) for b, v in zip(blocks, value) for k in ((2, 3) if b[2] != b[3] else (2,))]
    return Isotonic(np.array([p[0] for p in points]), np.array([p[1] for p in points]))
