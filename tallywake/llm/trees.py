"""Isolation forest and histogram gradient boosting, their trees flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows of a random binary tree."""
    n = np.asarray(n, float)
    big = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees of depth ``depth``: node i has children 2i+1 and 2i+2; ``path`` is a last-level node's path length."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    depth: int
    rows: int

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        inner, leaves = 2**depth - 1, 2**depth
        feature, cut = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf)
        path = np.zeros((trees, leaves))
        for t in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), rows, replace=False)])]
            while todo:
                node, level, part = todo.pop()
                spread = np.flatnonzero(part.max(0) > part.min(0)) if level < depth and len(part) > 1 else np.zeros(0, int)
                if not len(spread):
                    first = (node + 1) * 2 ** (depth - level) - 1 - inner  # its leaves on the last level
                    path[t, first : first + 2 ** (depth - level)] = level + _mean_path(len(part))
                    continue
                f = int(rng.choice(spread))
                at = rng.uniform(part[:, f].min(), part[:, f].max())
                feature[t, node], cut[t, node] = f, at
                left = part[:, f] <= at
                todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        return cls(feature, cut, path, depth, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row: near 1 for short paths, 0.5 for usual ones."""
        total, at = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, self.feature[t, node]] > self.cut[t, node])
            total += self.path[t, node - self.feature.shape[1]]
        return 2.0 ** (-total / len(self.feature) / max(float(_mean_path(self.rows)), 1e-9))


@dataclass
class BoostedTrees:
    """Trees of depth ``depth`` as arrays: node i has children 2i+1 and 2i+2, ``value`` is added at the last level."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> BoostedTrees:
        """Logistic loss; splits are found on histograms of quantile bins."""
        n, m = x.shape
        share = min(max((y.sum() + 0.5) / (n + 1), 1e-6), 1 - 1e-6) if n else 0.5
        base = float(np.log(share / (1 - share)))
        inner = 2**depth - 1
        feature, cut, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
        if n < 2 * least or len(np.unique(y)) < 2:
            return cls(feature[:0], cut[:0], value[:0], base, depth)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(m)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)], 1)
        raw = np.full(n, base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                local = node - first
                gain, best_f, best_b = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
                sums = [np.bincount(local, v, width) for v in (g, h)]
                for f in range(m):
                    key = local * bins + binned[:, f]
                    hg, hh, hn = (np.bincount(key, v, width * bins).reshape(width, bins).cumsum(1) for v in (g, h, None))
                    total_n = hn[:, -1:]
                    lg, lh = hg[:, :-1], hh[:, :-1]
                    rg, rh = sums[0][:, None] - lg, sums[1][:, None] - lh
                    gains = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (sums[0] ** 2 / (sums[1] + ridge))[:, None]
                    gains[(hn[:, :-1] < least) | (total_n - hn[:, :-1] < least)] = -1
                    gains[:, len(edges[f]) :] = -1
                    b = gains.argmax(1)
                    top = gains[np.arange(width), b]
                    better = top > gain
                    gain[better], best_f[better], best_b[better] = top[better], f, b[better]
                for k in np.flatnonzero(best_b >= 0):
                    feature[t, first + k], cut[t, first + k] = best_f[k], edges[best_f[k]][best_b[k]]
                node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
            leaf = node - inner
            value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            raw += value[t, leaf]
        return cls(feature, cut, value, base, depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        raw, at = np.full(len(x), self.base), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, self.feature[t, node]] > self.cut[t, node])
            raw += self.value[t, node - self.feature.shape[1]]
        return 1 / (1 + np.exp(-raw))
