"""Small tree learners in vector arithmetic: one classification tree, gradient-boosted trees
with logistic loss, isotonic calibration. They train on the driver on bounded tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: inner node n has children 2n+1 and 2n+2; feature -1 sends all left."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[at]
            right = (f >= 0) & (x[rows, np.maximum(f, 0)] > self.threshold[at])
            at = 2 * at + 1 + right
        return at - (2**self.depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Midpoints between quantiles of each feature."""
    out = []
    for column in x.T:
        u = np.unique(column)
        if len(u) > bins:
            u = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
        out.append((u[1:] + u[:-1]) / 2)
    return out


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, min_rows: int, bins: int = 64, ridge: float = 1.0) -> Tree:
    """The tree of best gain by second-order loss; leaf value is -G / (H + ridge)."""
    cuts = cut_points(x, bins)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1) if x.shape[1] else np.zeros((len(x), 0), np.int64)
    width = max([len(c) + 1 for c in cuts], default=1)
    inner = 2**depth - 1
    feature, threshold = np.full(inner, -1), np.zeros(inner)
    at = np.zeros(len(x), np.int64)
    for level in range(depth):
        first, count = 2**level - 1, 2**level
        local = at - first
        best = np.zeros(count)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            cell = local * width + binned[:, f]
            g, h, n = (np.bincount(cell, w, count * width).reshape(count, width).cumsum(axis=1) for w in (gradient, hessian, None))
            gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(n < min_rows) | (nt - n < min_rows)] = 0
            gain = gain[:, : len(c)]
            k = gain.argmax(axis=1)
            better = gain[np.arange(count), k] > best + 1e-9
            best[better] = gain[np.arange(count), k][better]
            feature[first : first + count][better] = f
            threshold[first : first + count][better] = c[k[better]]
        f = feature[at]
        at = 2 * at + 1 + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]))
    leaf = at - inner
    g, h = (np.bincount(leaf, w, 2**depth) for w in (gradient, hessian))
    return Tree(depth, feature, threshold, -g / (h + ridge))


def classification_tree(x: np.ndarray, y: np.ndarray, depth: int = 4, min_rows: int = 3) -> Tree:
    """Leaf values are the share of class 1. On squared loss the gain is that of Gini impurity."""
    t = grow(x, -y.astype(float), np.ones(len(y)), depth, min_rows, ridge=1e-9)
    return Tree(t.depth, t.feature, t.threshold, np.clip(t.value, 0, 1))


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Tree, ...]
    rate: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, min_rows: int = 10) -> Boosted:
    share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(y), start), []
    if 0 < y.sum() < len(y):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            trees.append(grow(x, p - y, p * (1 - p), depth, min_rows))
            margin = margin + rate * trees[-1].predict(x)
    return Boosted(start, tuple(trees), rate)


@dataclass(frozen=True)
class Isotonic:
    """A non-decreasing step function, linear between its knots."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


def isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Least squares under monotony, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # low score, high score, sum, count
    for s, v in zip(score[order], y[order].astype(float)):
        if blocks and blocks[-1][1] == s:
            blocks[-1][2] += v
            blocks[-1][3] += 1
        else:
            blocks.append([s, s, v, 1])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, _, total, n = blocks[-2]
            blocks[-2:] = [[low, blocks[-1][1], total + blocks[-1][2], n + blocks[-1][3]]]
    if not blocks:
        return Isotonic(np.array([0.0]), np.array([0.0]))
    xs = np.array([v for b in blocks for v in (b[0], b[1])])
    ys = np.array([v for b in blocks for v in (b[2] / b[3],) * 2])
    return Isotonic(xs, ys)
