"""A small random forest on binned features: bootstrap samples, random feature subsets, Gini splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays, one row per tree: feature (-1 at leaves), threshold, children, share of positives."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the trees, for each row of ``x``."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = self.feature[t][node]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[t][node], self.left[t][node], self.right[t][node])
                node = np.where(f >= 0, down, node)
            total += self.share[t][node]
        return total / max(1, len(self.feature))


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, bins: int = 32, least: int = 3, seed: int = 42) -> Forest:
    """Fit on all rows given; the same seed gives the same forest. One class, or no rows, gives a constant score."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(d)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(d)], axis=1) if n else np.zeros((0, d), int)
    pick = max(1, int(np.sqrt(d)) + 1)
    built = []
    for _ in range(trees):
        nodes: list[list] = []
        sample = rng.integers(0, n, n) if n else np.zeros(0, int)
        todo = [(sample, 0, None)]
        while todo:
            rows, level, parent = todo.pop()
            own = y[rows]
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, float(own.mean()) if len(own) else 0.0])
            if parent is not None:
                nodes[parent[0]][parent[1]] = at
            if level == depth or len(rows) < 2 * least or own.min() == own.max():
                continue
            best = None
            for f in rng.choice(d, pick, replace=False):
                size = len(cuts[f]) + 1
                total = np.cumsum(np.bincount(binned[rows, f], minlength=size))[:-1].astype(float)
                ones = np.cumsum(np.bincount(binned[rows, f], weights=own, minlength=size))[:-1]
                ok = (total >= least) & (len(rows) - total >= least)
                if not ok.any():
                    continue
                rest, rest_ones = len(rows) - total, own.sum() - ones
                with np.errstate(divide="ignore", invalid="ignore"):
                    impurity = np.where(ok, ones * (total - ones) / total + rest_ones * (rest - rest_ones) / rest, np.inf)
                k = int(impurity.argmin())
                if best is None or impurity[k] < best[0]:
                    best = (impurity[k], f, k)
            if best is None:
                continue
            _, f, k = best
            nodes[at][0], nodes[at][1] = int(f), float(cuts[f][k])
            below = binned[rows, f] <= k
            todo += [(rows[below], level + 1, (at, 2)), (rows[~below], level + 1, (at, 3))]
        built.append(nodes)
    width = max((len(b) for b in built), default=1)
    table = np.zeros((len(built), width, 5))
    table[:, :, 0] = -1
    for t, b in enumerate(built):
        table[t, : len(b)] = b
    return Forest(table[:, :, 0].astype(np.int32), table[:, :, 1], table[:, :, 2].astype(np.int32), table[:, :, 3].astype(np.int32), table[:, :, 4], depth)
