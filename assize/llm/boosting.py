"""Gradient-boosted trees over a few discrete features, fitted on counts and compiled to Spark columns.

The features of all rows are counted by combination in Spark; what reaches the driver is bounded by the
product of the features' values, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A split ``feature <= cut``, or a leaf if ``feature`` is None."""

    value: float
    feature: str | None = None
    cut: int = 0
    low: Node | None = None
    high: Node | None = None

    def of(self, row: dict) -> float:
        node = self
        while node.feature is not None:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.value

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(F.col(self.feature) <= self.cut, self.low.column()).otherwise(self.high.column())


def _grow(rows: list[tuple], names: list[str], depth: int, ridge: float) -> Node:
    """A regression tree of Newton steps over (features, gradient, curvature) rows."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Node(g / (h + ridge))
    best = (1e-6, None, 0)
    for k, name in enumerate(names) if depth else ():
        by: dict[int, list[float]] = {}
        for r in rows:
            at = by.setdefault(r[0][k], [0.0, 0.0])
            at[0] += r[1]
            at[1] += r[2]
        left_g = left_h = 0.0
        for value in sorted(by)[:-1]:
            left_g += by[value][0]
            left_h += by[value][1]
            gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            if gain > best[0]:
                best = (gain, name, value)
    if best[1] is None:
        return leaf
    k = names.index(best[1])
    low, high = [r for r in rows if r[0][k] <= best[2]], [r for r in rows if r[0][k] > best[2]]
    return Node(leaf.value, best[1], best[2], _grow(low, names, depth - 1, ridge), _grow(high, names, depth - 1, ridge))


@dataclass(frozen=True)
class Boosted:
    """A logistic model: an intercept and trees."""

    intercept: float
    trees: tuple[Node, ...]
    rate: float

    def probability(self, row: dict) -> float:
        return 1 / (1 + math.exp(-self.intercept - self.rate * sum(t.of(row) for t in self.trees)))

    def column(self) -> Column:
        score = F.lit(self.intercept)
        for tree in self.trees:
            score = score + self.rate * tree.column()
        return 1 / (1 + F.exp(-score))


def fit(counts: list[tuple[tuple, int, int]], names: list[str], trees: int = 20, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Boosted trees on (feature values, rows, positive rows)."""
    counts = sorted(counts)
    total, positive = sum(c[1] for c in counts), sum(c[2] for c in counts)
    intercept = math.log((positive + 0.5) / (total - positive + 0.5))
    score = [intercept] * len(counts)
    grown = []
    for _ in range(trees):
        rows = []
        for (values, n, ones), s in zip(counts, score):
            p = 1 / (1 + math.exp(-s))
            rows.append((values, ones - n * p, n * p * (1 - p)))
        tree = _grow(rows, names, depth, ridge)
        grown.append(tree)
        score = [s + rate * tree.of(dict(zip(names, c[0]))) for s, c in zip(score, counts)]
    return Boosted(intercept, tuple(grown), rate)


def cross_fitted(folds: list[list[tuple[tuple, int, int]]], names: list[str]) -> list[tuple[tuple, float, int, int]]:
    """(feature values, probability, rows, positive rows) of every fold under the model of all other folds."""
    out = []
    for k, held in enumerate(folds):
        model = fit([c for j, fold in enumerate(folds) if j != k for c in fold], names)
        out += [(values, model.probability(dict(zip(names, values))), n, ones) for values, n, ones in held]
    return out


def threshold(scored: list[tuple[float, int, int]], precision: float) -> float:
    """Of (probability, rows, positive rows): the lowest probability from which on rows are positive in a share of ``precision``, one more row that is not counted in; above one if there is none."""
    scored = sorted(scored, reverse=True)
    best, seen, hit = 1.1, 0, 0
    for k, (p, n, ones) in enumerate(scored):
        seen, hit = seen + n, hit + ones
        if (k + 1 == len(scored) or scored[k + 1][0] < p) and hit >= precision * (seen + 1):
            best = p
    return best
