"""Gradient-boosted trees for a yes/no target in numpy, with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """All trees' nodes one after another; a row goes left where its value is <= threshold. A leaf's children are itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, all trees at once."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 4.0) -> FlatTrees:
    """Trees for P(y = 1) by logistic loss on histograms.

    monotone: feature -> 1 (the score never falls as it grows) or -1. A split that would break a
    constraint isn't taken, and the values below a constrained split stay on their sides of its middle.
    least: smallest sum of second derivatives in a leaf. Without rows, or with one class alone, the
    result has no trees and a constant score.
    """
    monotone = monotone or {}
    n = len(y)
    share = (float(y.sum()) + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    empty = np.zeros(0)
    if n == 0 or y.min() == y.max():
        return FlatTrees(empty.astype(int), empty.astype(int), empty, empty.astype(int), empty.astype(int), empty, base, 0)
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    def best_split(rows, g, h, low, high):
        best = (1e-6, None)
        gs, hs = g[rows].sum(), h[rows].sum()
        whole = gs * gs / (hs + l2)
        for j in range(d):
            if not len(cuts[j]):
                continue
            m = len(cuts[j]) + 1
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], m))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], m))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            ok = (hl >= least) & (hr >= least)
            if j in monotone:
                ok &= (vr - vl) * monotone[j] >= 0
            gain = np.where(ok, -2 * gl * vl - (hl + l2) * vl**2 - 2 * gr * vr - (hr + l2) * vr**2 - whole, -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        return best[1]

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        todo = [(root, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            k, rows, low, high, level = todo.pop()
            split = best_split(rows, g, h, low, high) if level < depth else None
            if split is None:
                value[k] = rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
                margin[rows] += value[k]
                continue
            j, cut, vl, vr = split
            feature[k], threshold[k] = j, float(cuts[j][cut])
            left[k], right[k] = node(), node()
            goes = binned[rows, j] <= cut
            lows, highs = [low, low], [high, high]
            if sign := monotone.get(j, 0):
                middle = (vl + vr) / 2
                (highs if sign > 0 else lows)[0] = middle
                (lows if sign > 0 else highs)[1] = middle
            todo += [(left[k], rows[goes], lows[0], highs[0], level + 1), (right[k], rows[~goes], lows[1], highs[1], level + 1)]
    return FlatTrees(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), base, depth)
