"""Plain versions of what the library does in Spark."""

from __future__ import annotations

from collections import Counter

import numpy as np


def adjusted_rand(a, b) -> float:
    pairs = lambda counts: sum(n * (n - 1) / 2 for n in counts.values())
    same, rows, cols, n = pairs(Counter(zip(a, b))), pairs(Counter(a)), pairs(Counter(b)), len(a)
    expected = rows * cols / (n * (n - 1) / 2) if n > 1 else 0.0
    top = (rows + cols) / 2 - expected
    return 1.0 if top == 0 else (same - expected) / top


def ward_naive(x: np.ndarray) -> tuple[list[float], list[set[int]]]:
    """Heights of all merges, and the clusters when four are left: each step tries all pairs."""
    groups, heights, four = [{i} for i in range(len(x))], [], []
    while len(groups) > 1:
        if len(groups) == 4:
            four = [set(g) for g in groups]
        best = None
        for i in range(len(groups)):
            for j in range(i):
                p, q = x[list(groups[i])], x[list(groups[j])]
                h = (2 * len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum()) ** 0.5
                if best is None or h < best[0]:
                    best = (h, i, j)
        h, i, j = best
        heights.append(h)
        groups[j] |= groups.pop(i)
    return heights, four


def lloyd(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    while True:
        labels = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[labels == k].mean(0) if (labels == k).any() else c for k, c in enumerate(centres)])
        if np.allclose(new, centres):
            return labels
        centres = new


def modularity(w: np.ndarray, labels: np.ndarray, gamma: float) -> float:
    deg, whole = w.sum(1), w.sum()
    return sum(w[np.ix_(labels == c, labels == c)].sum() / whole - gamma * (deg[labels == c].sum() / whole) ** 2 for c in np.unique(labels))


def one_by_one(w: np.ndarray, gamma: float) -> np.ndarray:
    """Communities by moves of one node at a time, in order, and then of whole communities (dense)."""
    where, a = np.arange(len(w)), w.astype(float)
    while True:
        n, deg, whole = len(a), a.sum(1), a.sum()
        labels, moved = np.arange(n), True
        while moved:
            moved = False
            for i in range(n):
                links = np.bincount(labels, a[i], n)
                links[labels[i]] -= a[i, i]
                rest = np.bincount(labels, deg, n)
                rest[labels[i]] -= deg[i]
                value = np.where(links > 0, links - gamma * deg[i] * rest / whole, -np.inf)
                stay = links[labels[i]] - gamma * deg[i] * rest[labels[i]] / whole
                if value.max() > stay + 1e-12:
                    labels[i], moved = int(value.argmax()), True
        kept, labels = np.unique(labels, return_inverse=True)
        if len(kept) == n:
            return where
        s = np.eye(len(kept))[labels]
        a, where = s.T @ a @ s, labels[where]


def spectral_dense(w: np.ndarray, k: int) -> np.ndarray:
    deg = w.sum(1) + 1e-12
    vectors = np.linalg.eigh(w / np.sqrt(deg[:, None] * deg))[1][:, -k:]
    rest, pivots = vectors.copy(), []
    for _ in range(k):
        pivots.append(int((rest**2).sum(1).argmax()))
        q = rest[pivots[-1]] / np.linalg.norm(rest[pivots[-1]])
        rest = rest - np.outer(rest @ q, q)
    u, _, vt = np.linalg.svd(vectors[pivots].T)
    return np.abs(vectors @ u @ vt).argmax(1)
