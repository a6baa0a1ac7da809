"""Clustering of arrays of a bounded size: a year's network, or the micro-clusters of :mod:`panelwright.operators.points`.

All methods are deterministic. Points of any number are clustered there, in Spark rounds.
"""

from __future__ import annotations

import numpy as np


def relabel(labels: np.ndarray) -> np.ndarray:
    """Numbers in order of first appearance."""
    order: dict[int, int] = {}
    return np.array([order.setdefault(int(x), len(order)) for x in labels], dtype=np.int64)


def lloyd(x: np.ndarray, centres: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    labels = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        d = ((x[:, None, :] - centres[None]) ** 2).sum(-1)
        labels = d.argmin(1)
        new = np.array([x[labels == k].mean(0) if (labels == k).any() else centres[k] for k in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return labels, float(((x - centres[labels]) ** 2).sum())


def kmeans(x: np.ndarray, k: int, starts: int = 20, seed: int = 42) -> np.ndarray:
    """The best of several runs from spread-out (k-means++) starts."""
    best = (np.inf, None)
    for s in range(starts):
        r = np.random.default_rng(seed + s)
        c = [x[r.integers(len(x))]]
        while len(c) < k:
            d = np.min([((x - a) ** 2).sum(1) for a in c], axis=0)
            c.append(x[r.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[r.integers(len(x))])
        labels, cost = lloyd(x, np.array(c))
        if cost < best[0] - 1e-12:
            best = (cost, labels)
    return relabel(best[1])


def ward_tree(x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Merges ``(a, b, height, size)`` by nearest-neighbour chains with the Lance-Williams update; n numbers up.

    ``weights``: points that each row of ``x`` is the mean of."""
    n = len(x)
    size = np.ones(n) if weights is None else np.asarray(weights, float).copy()
    d = np.zeros((n, n))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - x[None, :, j]) ** 2
    d = np.sqrt(d * (2 * size[:, None] * size / (size[:, None] + size)))
    np.fill_diagonal(d, np.inf)
    counted = size.copy()
    live, chain, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            row = np.where(live, d[a], np.inf)
            row[a] = np.inf
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        h, sa, sb = d[a, b], size[a], size[b]
        merges.append((a, b, h))
        total = sa + sb + size
        new = np.sqrt(np.maximum(((sa + size) * d[a] ** 2 + (sb + size) * d[b] ** 2 - size * h**2) / total, 0))
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        live[b], size[a] = False, sa + sb
    merges.sort(key=lambda m: m[2])
    root, count, name, out = list(range(n)), counted.tolist(), list(range(n)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for step, (a, b, h) in enumerate(merges):
        p, q = find(a), find(b)
        root[q] = p
        count[p] += count[q]
        out.append((min(name[p], name[q]), max(name[p], name[q]), h, count[p]))
        name[p] = n + step
    return np.array(out)


def cut(tree: np.ndarray, n: int, k: int) -> np.ndarray:
    root = list(range(2 * n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for step, (a, b, _, _) in enumerate(tree[: n - k]):
        root[find(int(a))] = root[find(int(b))] = n + step
    return relabel(np.array([find(i) for i in range(n)]))


def network_kmeans(x: np.ndarray, w: np.ndarray, k: int, rho: float = 1.0, xi: float = 1.0, starts: int = 10) -> np.ndarray:
    """K-means on features and network rows together, weighted by ``rho`` and ``xi``."""
    return kmeans(np.hstack([np.sqrt(rho) * x, np.sqrt(xi) * w]), k, starts)


#: Methods that take points and a network here.
BOTH = {"kefrin_like": network_kmeans}
#: Methods of :mod:`panelwright.operators.points` and of :mod:`panelwright.operators.communities`.
POINTS, NETWORK = ("kmeans", "ward", "ward_kmeans", "gmm_diag"), ("spectral", "leiden")


def available(method: str) -> tuple[bool, str]:
    known = method in POINTS or method in NETWORK or method in BOTH
    return known, "" if known else "no such method here"


def fit(x: np.ndarray | None, w: np.ndarray | None, method: str, k: int) -> np.ndarray:
    if method not in BOTH:
        raise ValueError(method)
    if w is None:
        raise ValueError("this method needs a network")
    return BOTH[method](x, w, k)
