"""Small learners trained on the driver from a bounded sample: boosted trees, logistic regression, calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bounded_sample(df, hash_col: str, n: int, total: int | None = None):
    """At most n rows as pandas, those of the smallest hashes. The executors thin the rows out before any is sent on.

    total: the number of rows, where it is known."""
    from pyspark.sql import functions as F

    total = df.count() if total is None else total
    if total > n:
        df = df.where(F.pmod(F.col(hash_col), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 1.1 * n / total + 1e-4)))
    return df.orderBy(F.pmod(F.col(hash_col), F.lit(1_000_003)), hash_col).limit(n).toPandas()


class Boosted:
    """Gradient-boosted binary trees on binned features, logistic loss, with calibrated probabilities."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.a, self.b, self.threshold = 0.0, 1.0, 0.0, 0.5

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        hold = np.arange(len(y)) % 4 == 3
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        xb, yt = self._bin(x[~hold]), y[~hold].astype(float)
        p = np.clip(yt.mean() if len(yt) else 0.5, 0.01, 0.99)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(yt), self.base)
        for _ in range(self.rounds):
            q = sigmoid(f)
            tree = self._grow(xb, yt - q, q * (1 - q))
            self.trees.append(tree)
            f += self.rate * self._apply(tree, xb)
        # Platt scaling on rows the trees have not seen
        z, yh = self.raw(x[hold]), y[hold].astype(float)
        if len(yh) > 20 and 0 < yh.mean() < 1:
            self.a, self.b = logistic(z[:, None], yh, l2=1e-3)
            self.a = float(self.a[0])
            self.threshold = best_threshold(sigmoid(self.a * z + self.b), yh)
        return self

    def _grow(self, xb: np.ndarray, g: np.ndarray, h: np.ndarray):
        nodes = 2**self.depth - 1
        feat, cut = np.zeros(nodes, int), np.full(nodes, 10**6)
        where = np.zeros(len(g), int)
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            local = where - first
            for j in range(xb.shape[1]):
                k = len(self.edges[j]) + 1
                if k < 2:
                    continue
                idx = local * k + xb[:, j]
                gs = np.bincount(idx, g, n * k).reshape(n, k).cumsum(1)
                hs = np.bincount(idx, h, n * k).reshape(n, k).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                at = gain[:, :-1].argmax(1)
                val = gain[np.arange(n), at]
                better = val > best
                best[better] = val[better]
                feat[first : first + n][better] = j
                cut[first : first + n][better] = at[better]
            where = 2 * where + 1 + (xb[np.arange(len(g)), feat[where]] > cut[where])
        leaf = where - nodes
        gs, hs = np.bincount(leaf, g, nodes + 1), np.bincount(leaf, h, nodes + 1)
        return feat, cut, gs / (hs + self.l2)

    def _apply(self, tree, xb: np.ndarray) -> np.ndarray:
        feat, cut, leaf = tree
        where = np.zeros(len(xb), int)
        for _ in range(self.depth):
            where = 2 * where + 1 + (xb[np.arange(len(xb)), feat[where]] > cut[where])
        return leaf[where - len(feat)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        xb = self._bin(x)
        f = np.full(len(x), self.base)
        for t in self.trees:
            f += self.rate * self._apply(t, xb)
        return f

    def prob(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.raw(x) + self.b)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The calibrated probability from which F1 is highest, within 0.2 and 0.8; of equal ones the nearest to 0.5."""
    grid = sorted(np.arange(0.2, 0.801, 0.05), key=lambda t: abs(t - 0.5))
    f1 = [2 * y[p >= t].sum() / max((p >= t).sum() + y.sum(), 1) for t in grid]
    return float(grid[int(np.argmax(f1))])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method."""
    xa = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xa.shape[1])
    reg = np.full(xa.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(xa @ w)
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((xa * s[:, None]).T @ xa + np.diag(reg), xa.T @ (y - p) - reg * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])
