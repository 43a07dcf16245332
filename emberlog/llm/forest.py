"""A small random forest: grown with numpy on a bounded table, scored as one SQL expression."""

from __future__ import annotations

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, leaf: int = 4, seed: int = 7) -> list:
    """Trees as nested tuples (feature, cut, left, right) with shares of label 1 at the leaves."""
    rng = np.random.default_rng(seed)
    tries = max(2, int(np.ceil(np.sqrt(x.shape[1]))) + 1)

    def node(rows: np.ndarray, left: int):
        labels = y[rows]
        if left == 0 or len(rows) < 2 * leaf or labels.min() == labels.max():
            return float(labels.mean())
        best = None
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order) + 1)
            p, q = ones / n, (ones[-1] - ones) / np.maximum(1, len(order) - n)
            cost = n * p * (1 - p) + (len(order) - n) * q * (1 - q)
            cost[np.append(v[1:] == v[:-1], True) | (n < leaf) | (len(order) - n < leaf)] = np.inf
            i = int(cost.argmin())
            if np.isfinite(cost[i]) and (best is None or cost[i] < best[0]):
                best = (cost[i], int(f), float((v[i] + v[i + 1]) / 2))
        if best is None:
            return float(labels.mean())
        _, f, cut = best
        low = x[rows, f] <= cut
        return (f, cut, node(rows[low], left - 1), node(rows[~low], left - 1))

    return [node(np.sort(rng.integers(0, len(y), len(y))), depth) for _ in range(trees)]


def share(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def predict(forest: list, x: np.ndarray) -> np.ndarray:
    return np.array([sum(share(t, r) for t in forest) / len(forest) for r in x])


def as_sql(forest: list, names: list[str]) -> str:
    """The forest's mean vote as a SQL expression over columns of these names."""

    def text(t) -> str:
        if not isinstance(t, tuple):
            return f"{t:.6f}D"
        return f"IF({names[t[0]]} <= {t[1]!r}D, {text(t[2])}, {text(t[3])})"

    return f"({' + '.join(text(t) for t in forest)}) / {len(forest)}D"
