"""A complete vantage-point tree over norm-augmented vectors.

A vector x gets one more component, sqrt(M - |x|^2) for the largest squared norm M, and a query gets 0 there. The squared
distance of a query q is then |q|^2 + M - 2 q.x, so the highest inner products are the nearest vectors, and a
range of inner products is an annulus around the query. A node's vantage point sorts its rows into an inner and an outer half by
distance; distances of a query to the vantage points bound those to every row of a leaf by the triangle inequality.
"""

from __future__ import annotations

import numpy as np


def augmented(x: np.ndarray, most: int) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate((x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]), 1)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * x @ points.T))


class Tree:
    """Levels of 1, 2, 4 ... nodes: vantage points, radii, and for each child the least and greatest distance of its rows."""

    def __init__(self, x: np.ndarray, depth: int, open_ends: bool = False):
        """x: augmented rows. open_ends: bounds hold for all vectors that route() sends down a side, not only for the rows of x."""
        self.depth, self.most = depth, float((x * x).sum(1).max(initial=0.0))
        self.points, self.radii, self.low, self.high = [], [], [], []
        leaf = np.zeros(len(x), np.int64)
        for level in range(depth):
            n = 1 << level
            points, radii = np.zeros((n, x.shape[1])), np.zeros(n)
            low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
            order = np.argsort(leaf, kind="stable")
            bounds = np.searchsorted(leaf[order], np.arange(n + 1))
            to = 2 * leaf
            for node in range(n):
                rows = order[bounds[node] : bounds[node + 1]]
                if not len(rows):
                    continue
                own = x[rows]
                far = distances(own, own.mean(0, keepdims=True))[:, 0]
                points[node] = own[far.argmax()]  # a row at the rim parts the others best
                d = distances(own, points[node : node + 1])[:, 0]
                radii[node] = np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]
                outer = d > radii[node]
                to[rows] += outer
                for side, mask in ((0, ~outer), (1, outer)):
                    if mask.any():
                        low[node, side], high[node, side] = d[mask].min(), d[mask].max()
            if open_ends:
                low, high = np.stack((np.zeros(n), radii), 1), np.stack((radii, np.full(n, np.inf)), 1)
            for into, part in ((self.points, points), (self.radii, radii), (self.low, low), (self.high, high)):
                into.append(part)
            leaf = to
        self.leaf = leaf

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each augmented row."""
        node = np.zeros(len(x), np.int64)
        for points, radii in zip(self.points, self.radii, strict=True):
            d = np.empty(len(x))
            for v in np.unique(node):
                at = node == v
                d[at] = distances(x[at], points[v : v + 1])[:, 0]
            node = 2 * node + (d > radii[node])
        return node

    def reach(self, q: np.ndarray, squared: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each augmented query (with |q|^2) and leaf, the least and greatest inner product that a row of the leaf can have; rounding is allowed for."""
        low, high = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        for points, least, greatest in zip(self.points, self.low, self.high, strict=True):
            d = distances(q, points)[:, :, None]
            low = np.maximum(low[:, :, None], np.maximum(d - greatest, least - d)).reshape(len(q), -1)
            high = np.minimum(high[:, :, None], d + greatest).reshape(len(q), -1)
        total = squared[:, None] + float(most)
        slack = 1 + 1e-7 * total
        return (total - high * high) / 2 - slack, (total - low * low) / 2 + slack


def nearest(tree: Tree, x: np.ndarray, ids: np.ndarray, allowed, q: np.ndarray, at: np.ndarray, least: np.ndarray, greatest: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window w, the k rows with the highest inner products among those in [least[w], greatest[w]], ties by smaller id; more of equal score may come.

    x: whole numbers by row of the tree; q: whole-number queries; at: the query of each window; allowed(windows, rows): which rows a window may
    have. Leaves are taken nearest first, each window its own next one, until the k-th score found is out of reach of the next.
    Returns window, row, score.
    """
    exact = np.float64 if int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(x.shape[1], 1) < 1 << 53 else np.int64
    squared = (q.astype(np.float64) ** 2).sum(1)
    low, high = tree.reach(np.concatenate((q.astype(np.float64), np.zeros((len(q), 1))), 1), squared, most)
    order = np.argsort(tree.leaf, kind="stable")
    bounds = np.searchsorted(tree.leaf[order], np.arange(low.shape[1] + 1))
    by_leaf = x[order].astype(exact)
    sequence = np.argsort(-high, axis=1, kind="stable")
    qx = q.astype(exact)
    floor = least.astype(np.float64)
    window, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    live = np.arange(len(at))
    for turn in range(low.shape[1]):
        leaf = sequence[at[live], turn]
        inside = high[at[live], leaf] >= floor[live]  # all later leaves are out of reach as well
        live, leaf = live[inside], leaf[inside]
        if not len(live):
            break
        use = low[at[live], leaf] <= greatest[live]
        found = []
        for one in np.unique(leaf[use]):
            rows = order[bounds[one] : bounds[one + 1]]
            if not len(rows):
                continue
            w = live[use & (leaf == one)]
            asked, back = np.unique(at[w], return_inverse=True)
            s = (qx[asked] @ by_leaf[bounds[one] : bounds[one + 1]].T)[back]
            ok = (s >= floor[w][:, None]) & (s <= greatest[w][:, None]) & allowed(w, rows)
            if len(rows) > k:
                cut = np.partition(np.where(ok, s, -np.inf), len(rows) - k, axis=1)[:, len(rows) - k]
                ok &= s >= cut[:, None]
            i, j = np.nonzero(ok)
            found.append((w[i], rows[j], s[i, j].astype(np.int64)))
        if found:
            window, row, score = (np.concatenate(p) for p in zip((window, row, score), *found, strict=True))
            rank = np.lexsort((ids[row], -score, window))
            window, row, score = window[rank], row[rank], score[rank]
            first = np.searchsorted(window, np.arange(len(at)))
            keep = np.arange(len(window)) - first[window] < k
            window, row, score = window[keep], row[keep], score[keep]
            count = np.bincount(window, minlength=len(at))
            full = np.flatnonzero(count >= k)
            floor[full] = np.maximum(floor[full], score[np.cumsum(count)[full] - 1])
    return window, row, score
