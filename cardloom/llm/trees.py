"""Small decision trees and gradient boosting in numpy, for models that the driver fits on a bounded table and every task applies."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


def _edges(column: np.ndarray) -> np.ndarray:
    values = np.unique(column)
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))


@dataclass
class Tree:
    """feature -1 marks a leaf; rows go left where value <= threshold."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def _add(self, value: float) -> int:
        for part, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            part.append(x)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = self._arrays()
        at = np.zeros(len(x), dtype=int)
        while len(live := np.flatnonzero(feature[at] >= 0)):
            node = at[live]
            at[live] = np.where(x[live, feature[node]] <= threshold[node], left[node], right[node])
        return value[at]

    def value_of(self, row: list[float]) -> float:
        """The value of a single row: for a few rows walking down is less work than arrays."""
        feature, threshold, left, right, at = self.feature, self.threshold, self.left, self.right, 0
        while (j := feature[at]) >= 0:
            at = left[at] if row[j] <= threshold[at] else right[at]
        return self.value[at]

    def _arrays(self) -> tuple[np.ndarray, ...]:
        """The columns as arrays; kept while no node is added."""
        got = self.__dict__.get("_kept")
        if got is None or len(got[0]) != len(self.feature):
            got = self.__dict__["_kept"] = tuple(np.array(p) for p in (self.feature, self.threshold, self.left, self.right, self.value))
        return got

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}


class Binned:
    """Rows in bins, cut once for all trees that are fitted on them."""

    def __init__(self, x: np.ndarray):
        self.edges = [_edges(x[:, j]) for j in range(x.shape[1])]
        self.columns = [j for j, e in enumerate(self.edges) if len(e)]
        self.width = max((len(e) for e in self.edges), default=0) + 1
        self.bins = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in self.columns], axis=1) if self.columns else np.zeros((len(x), 0), dtype=int)
        self.flat = self.bins + np.arange(len(self.columns)) * self.width
        # Places behind a column's last edge can't split it.
        self.open = np.array([[k < len(self.edges[j]) for k in range(self.width)] for j in self.columns]).reshape(len(self.columns), self.width)

    def sums(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Running sums of weights over the bins of every column."""
        n = len(self.columns)
        return np.bincount(self.flat[rows].ravel(), np.repeat(weights[rows], n), n * self.width).reshape(n, self.width).cumsum(axis=1)


def fit_tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float, ridge: float = 1.0, binned: Binned | None = None) -> Tree:
    """A second-order regression tree: leaves are -G / (H + ridge), splits gain the most of G^2 / (H + ridge)."""
    binned = binned or Binned(x)
    tree = Tree()

    def grow(rows: np.ndarray, level: int) -> int:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        node = tree._add(float(-g / (h + ridge)))
        if level == depth or h < 2 * least or not binned.columns:
            return node
        gs, hs = binned.sums(rows, gradient), binned.sums(rows, hessian)
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[(hs < least) | (h - hs < least) | ~binned.open] = 0
        at = int(gain.argmax())
        if gain.flat[at] > 1e-6:
            c, k = divmod(at, binned.width)
            j = binned.columns[c]
            go = binned.bins[rows, c] <= k
            tree.feature[node], tree.threshold[node] = j, float(binned.edges[j][k])
            tree.left[node] = grow(rows[go], level + 1)
            tree.right[node] = grow(rows[~go], level + 1)
        return node

    grow(np.arange(len(x)), 0)
    return tree


@dataclass
class Boosted:
    """Trees whose sum is a log-odds, put right by a slope and an intercept fitted on rows held out of the training."""

    start: float
    rate: float
    trees: list[Tree]
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def fit_boosted(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 2.0) -> Boosted:
    """Logistic gradient boosting. Equal rows are put together first: they only count more."""
    rows, inverse, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse.ravel(), y, len(rows)) / n
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), rate, [])
    score, binned = np.full(len(rows), model.start), Binned(rows)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        tree = fit_tree(rows, n * (q - mean), n * np.maximum(q * (1 - q), 1e-3), depth, least / 4, binned=binned)
        model.trees.append(tree)
        score += rate * tree.predict(rows)
    return model


def calibrated(model: Boosted, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that put the log-odds of a model right on rows it was not fitted on (Platt)."""
    raw, target = model.raw(x), np.clip(y, 0.02, 0.98)
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-6)
        g = np.array([((q - target) * raw).sum() + 0.1 * (a - 1), (q - target).sum()])
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)
