"""Histogram gradient-boosted trees for a yes-or-no label, in numpy.

Training bins every feature once and grows trees level by level from per-bin sums of
gradients. A fitted forest is three flat arrays in heap order, so scoring a batch is
``depth`` rounds of array look-ups for all rows and trees together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Gradients are summed in whole parts of this, so that no order of summing changes a sum.
UNIT = 2.0**20


@dataclass(frozen=True)
class Forest:
    """``feature`` and ``threshold`` hold the inner nodes of each tree (heap order; larger goes
    right), ``leaf`` the values at the bottom."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        rows = np.asarray(rows, np.float64)
        trees = np.arange(len(self.leaf))[None, :]
        total = np.full(len(rows), self.base)
        if len(self.leaf):
            node = np.zeros((len(rows), len(self.leaf)), np.int64)
            at = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                right = rows[at, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            total = total + self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between neighbouring values: all of them if few, else at quantiles."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
    return (values[:-1] + values[1:]) / 2


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    *,
    rounds: int = 80,
    depth: int = 4,
    bins: int = 128,
    rate: float = 0.15,
    ridge: float = 1.0,
    least: float = 1.0,
) -> Forest:
    """Boosted trees of logistic loss. Without rows the score is 0.5; with one class only it is
    that class's smoothed share. The same rows in the same order give the same forest."""
    labels = np.asarray(labels, np.float64)
    base = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(np.unique(labels)) < 2:
        return Forest(depth, base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    rows = np.asarray(rows, np.float64)
    width = rows.shape[1]
    edges = [_edges(rows[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], 1)
    cell = binned + np.arange(width)[None, :] * bins
    feature, threshold, leaf = [], [], []
    total = np.full(len(rows), base)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-total))
        gradient, weight = labels - p, p * (1 - p)
        f_tree, t_tree = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            flat = (node[:, None] * (width * bins) + cell).ravel()
            size = count * width * bins
            shape = (count, width, bins)
            g = np.bincount(flat, np.repeat(gradient, width), size).reshape(shape).cumsum(2)
            h = np.bincount(flat, np.repeat(weight, width), size).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least) | (h_all - h < least)] = -1.0
            best = gain.reshape(count, -1).argmax(1)
            f_best, b_best = best // bins, best % bins
            for k in range(count):
                if gain[k, f_best[k], b_best[k]] > 1e-9 and b_best[k] < len(edges[f_best[k]]):
                    f_tree[first + k], t_tree[first + k] = f_best[k], edges[f_best[k]][b_best[k]]
            at = first + node
            node = 2 * node + (rows[np.arange(len(rows)), f_tree[at]] > t_tree[at])
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, weight, leaves)
        values = rate * g / (h + ridge)
        total = total + values[node]
        feature.append(f_tree)
        threshold.append(t_tree)
        leaf.append(values)
    return Forest(depth, base, np.array(feature), np.array(threshold), np.array(leaf))


def level_sums(
    rows: np.ndarray, labels: np.ndarray, counts: np.ndarray, forest: Forest, feature: np.ndarray, threshold: np.ndarray, level: int, bins: int
) -> np.ndarray:
    """Gradients and their weights, in parts of ``UNIT``, of binned rows that occur ``counts`` times: by
    node, feature and bin of a level of the tree that is being grown, or by leaf below its last one."""
    p = forest.score(rows)
    values = (np.rint((labels - p) * UNIT) * counts, np.rint(p * (1 - p) * UNIT) * counts)
    node = np.zeros(len(rows), np.int64)
    for depth in range(level):
        at = 2**depth - 1 + node
        node = 2 * node + (rows[np.arange(len(rows)), feature[at]] > threshold[at])
    if level == forest.depth:
        return np.stack([np.bincount(node, v, 2**level) for v in values]).astype(np.int64)
    width = rows.shape[1]
    cell = (node[:, None] * width + np.arange(width)) * bins + rows
    size = 2**level * width * bins
    return np.stack([np.bincount(cell.ravel(), np.repeat(v, width), size) for v in values]).astype(np.int64)


def grow(
    sums: Callable[[Forest, np.ndarray, np.ndarray, int], np.ndarray],
    no: int,
    yes: int,
    width: int,
    bins: int,
    *,
    rounds: int,
    depth: int,
    rate: float = 0.15,
    ridge: float = 1.0,
    least: float = 1.0,
) -> Forest:
    """Boosted trees as ``fit`` grows them, from rows that lie elsewhere: features are whole numbers
    below ``bins``, ``no`` and ``yes`` count the labels, and ``sums`` gives the ``level_sums`` over all rows."""
    base = float(np.log((yes + 1) / (no + 1)))
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(depth, base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    for _ in range(rounds if no and yes else 0):
        f_tree, t_tree = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            g, h = (sums(forest, f_tree, t_tree, level) / UNIT).reshape(2, 2**level, width, bins).cumsum(3)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least) | (h_all - h < least)] = -1.0
            best = gain.reshape(2**level, -1).argmax(1)
            for k, (f, b) in enumerate(zip(best // bins, best % bins)):
                if gain[k, f, b] > 1e-9:
                    f_tree[2**level - 1 + k], t_tree[2**level - 1 + k] = f, b + 0.5
        g, h = sums(forest, f_tree, t_tree, depth) / UNIT
        parts = zip((forest.feature, forest.threshold, forest.leaf), (f_tree, t_tree, rate * g / (h + ridge)))
        forest = Forest(depth, base, *[np.concatenate([done, new[None]]) for done, new in parts])
    return forest
