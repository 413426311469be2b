"""Spanning forests of links inside one task, without a Python loop over the links."""

from __future__ import annotations

import numpy as np


class Forest:
    """Labels of n nodes; links are given in arrays, and those that join two trees are kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            root, first = np.unique(high, return_index=True)  # one link for each tree that is hung on a lower one
            self.edges.append(np.stack([a[first], b[first]]))
            parent = np.arange(len(self.label))
            parent[root] = low[first]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]

    def links(self) -> np.ndarray:
        return np.concatenate(self.edges, axis=1) if self.edges else np.zeros((2, 0), np.int64)
