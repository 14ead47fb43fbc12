"""Small numeric helpers on one group: optimal assignment and centroid linkage."""

from __future__ import annotations

import numpy as np


def best_assignment(scores: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs with the greatest total, each row and column used once at most; min(rows, columns) pairs.
    Shortest augmenting paths with potentials; equal totals are settled by the order of the columns."""
    if not scores.size:
        return []
    turned = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if turned else scores).astype(float)
    n, m = cost.shape
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        r, base, reached = row, 0.0, -1
        seen = [(row, 0.0)]
        while True:
            reach = base + cost[r] - row_pot[r] - col_pot
            better = ~done & (reach < dist - 1e-12)
            dist[better], back[better] = reach[better], reached
            reached = int(np.argmin(np.where(done, np.inf, dist)))
            base = dist[reached]
            done[reached] = True
            if owner[reached] < 0:
                break
            r = int(owner[reached])
            seen.append((r, base))
        for r, at in seen:
            row_pot[r] += base - at
        col_pot[done] -= base - dist[done]
        while reached >= 0:
            before = back[reached]
            owner[reached] = owner[before] if before >= 0 else row
            reached = before
    return sorted((c, int(r)) if turned else (int(r), c) for c, r in enumerate(owner) if r >= 0)


class Linkage:
    """Centroid linkage of unit vectors: merges of two nodes, their distance, and the size of what results.

    Distances need not grow from merge to merge. A cut at t keeps a node whole if no merge inside of it is above t.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        sq = np.maximum(0.0, 2 - 2 * (x @ x.T))
        np.fill_diagonal(sq, np.inf)
        near, size, node = sq.argmin(axis=1) if n else np.empty(0, int), np.ones(n), np.arange(n)
        alive = np.ones(n, dtype=bool)
        self.n, self.merges, self.heights, self.sizes = n, [], [], []
        for step in range(n - 1):
            best = np.where(alive, sq[np.arange(n), near], np.inf)
            i = int(best.argmin())
            j = int(near[i])
            i, j = min(i, j), max(i, j)
            d2 = sq[i, j]
            self.merges.append((int(node[i]), int(node[j])))
            self.heights.append(float(np.sqrt(max(d2, 0.0))))
            both = size[i] + size[j]
            row = (size[i] * sq[i] + size[j] * sq[j]) / both - size[i] * size[j] * d2 / both**2
            alive[j] = False
            row[~alive] = row[i] = np.inf
            sq[i], sq[:, i] = row, row
            sq[j], sq[:, j] = np.inf, np.inf
            size[i], node[i] = both, n + step
            self.sizes.append(int(both))
            stale = alive & ((near == i) | (near == j))
            stale[i] = alive[i]
            near[stale] = sq[stale].argmin(axis=1)
            closer = alive & (row < sq[np.arange(n), near])
            near[closer] = i

    def cut(self, threshold: float) -> np.ndarray:
        """Clusters at a threshold, numbered by their first member."""
        whole = np.ones(self.n + len(self.merges), dtype=bool)
        for k, ((a, b), h) in enumerate(zip(self.merges, self.heights)):
            whole[self.n + k] = whole[a] and whole[b] and h <= threshold
        return self._labels(whole)

    def after(self, merges: int) -> np.ndarray:
        """Clusters once so many merges are done, numbered by their first member."""
        return self._labels(np.arange(self.n + len(self.merges)) < self.n + merges)

    def _labels(self, whole: np.ndarray) -> np.ndarray:
        """Members numbered by the topmost whole node above them."""
        top = np.arange(len(whole))
        for k in np.flatnonzero(whole[self.n :])[::-1]:
            top[list(self.merges[k])] = top[self.n + k]
        _, first, inverse = np.unique(top[: self.n], return_index=True, return_inverse=True)
        return np.unique(first[inverse], return_inverse=True)[1]

    def nearest(self, wanted: int, threshold: float, least: int) -> np.ndarray:
        """Clusters of the cut whose number of clusters of `least` members is closest to `wanted`; of equal ones the cut nearest
        to the threshold. Cuts lie behind merges that make such a cluster; one cluster if none is closer than that."""
        large = np.r_[np.ones(self.n, dtype=int), np.array(self.sizes, dtype=int)] >= least
        merged = large[np.array(self.merges)].sum(axis=1)
        off = np.abs(large[: self.n].sum() + np.cumsum(large[self.n :] - merged) - wanted)
        order = np.lexsort((np.abs(np.array(self.heights) - threshold), off))
        fit = order[(large[self.n :] & (off < abs(1 - wanted)))[order]]
        return self.after(int(fit[0]) + 1 if len(fit) else len(self.merges))


def join_small(x: np.ndarray, labels: np.ndarray, least: int) -> np.ndarray:
    """Clusters of under `least` members as part of the large one whose centre is nearest; all as one if none is large."""
    large = np.bincount(labels) >= least
    if not large.any():
        return np.zeros(len(x), dtype=int)
    centres = np.zeros((len(large), x.shape[1]))
    np.add.at(centres, labels, x)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    host = np.arange(len(large))
    host[~large] = np.flatnonzero(large)[(centres[~large] @ centres[large].T).argmax(axis=1)]
    return np.unique(host[labels], return_inverse=True)[1]


def clusters(x: np.ndarray, threshold: float, least: int, low: int = 1, high: int = 20, exact: int | None = None) -> np.ndarray:
    """Clusters of unit vectors: centroid linkage cut at the threshold, or, if that gives fewer than low or more than high
    clusters of `least` members (a tenth of all at most), or not the exact number, cut where their number comes closest.
    Smaller clusters join the nearest large one."""
    if len(x) < 2 or high < 2:
        return np.zeros(len(x), dtype=int)
    least = min(least, max(1, round(0.1 * len(x))))
    tree = Linkage(x)
    labels = tree.cut(threshold)
    found = int((np.bincount(labels) >= least).sum())
    wanted = min(max(found, low), high)
    if wanted == found and exact is not None:
        wanted = exact
    return join_small(x, labels if wanted == found else tree.nearest(wanted, threshold, least), least)
