"""A tree of pivots over the rows of a table, and exact searches for nearest neighbours with it.

The tree's shape comes from a bounded sample: a node sends a row to the nearer of its two pivots. All rows
then go down to their leaf, and a leaf's box and ball are taken over all of its rows, so the bounds are true.
A search has two passes. First a query is compared with the leaves near it that hold k rows, which gives it k
real distances. Then it goes down the tree into every node that may hold a nearer row than the k-th of them.
Leaves stand in blocks of bounded size; a block keeps a running best k per query and sends only that.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Rows that shape the tree, and leaves it may have.
SAMPLE_ROWS, MAX_LEAVES = 32_768, 8_192
_SLACK = 1e-9


def norm(gap: np.ndarray, p: float) -> np.ndarray:
    """Minkowski length along the last axis of absolute differences."""
    if p == 1:
        return gap.sum(axis=-1)
    if p == 2:
        return np.sqrt((gap * gap).sum(axis=-1))
    return (gap**p).sum(axis=-1) ** (1.0 / p)


def distances(x: np.ndarray, to: np.ndarray, p: float) -> np.ndarray:
    out = np.empty((len(x), len(to)))
    block = max(1, 1_000_000 // max(1, to.size))
    for i in range(0, len(x), block):
        out[i : i + block] = norm(np.abs(x[i : i + block, None, :] - to[None, :, :]), p)
    return out


@dataclass
class MetricTree:
    """Nodes in breadth-first order: `left` and `right` children (-1: a leaf) and their pivots.

    `bounded` adds what all rows of a leaf have: their number, box, and ball around the leaf's centre.
    """

    p: float
    left: np.ndarray
    right: np.ndarray
    pivots: np.ndarray  # per node, the pivot that leads to it
    leaf: np.ndarray  # number of the leaf, or -1
    size: np.ndarray = field(default_factory=lambda: np.empty(0))
    low: np.ndarray = field(default_factory=lambda: np.empty(0))
    high: np.ndarray = field(default_factory=lambda: np.empty(0))
    reach: np.ndarray = field(default_factory=lambda: np.empty(0))

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    @classmethod
    def shaped(cls, sample: np.ndarray, leaves: int, p: float) -> MetricTree:
        """Nodes are split, the fullest first, between two far rows until there are `leaves` leaves."""
        left, right, pivots, rows = [-1], [-1], [sample.mean(axis=0)], [np.arange(len(sample))]
        waiting = [(-len(sample), 0)]
        while waiting and len(waiting) < leaves:
            at = heapq.heappop(waiting)[1]
            own = sample[rows[at]]
            a = own[np.argmax(norm(np.abs(own - pivots[at]), p))]
            b = own[np.argmax(norm(np.abs(own - a), p))]
            for _ in range(3):  # towards the means of the halves, which balances them
                nearer = norm(np.abs(own - a), p) <= norm(np.abs(own - b), p)
                if nearer.all():
                    break
                a, b = own[nearer].mean(axis=0), own[~nearer].mean(axis=0)
            nearer = norm(np.abs(own - a), p) <= norm(np.abs(own - b), p)
            if nearer.all() or not nearer.any():
                break  # the fullest node holds equal rows only
            for side, pivot in ((nearer, a), (~nearer, b)):
                left.append(-1)
                right.append(-1)
                pivots.append(pivot)
                rows.append(rows[at][side])
                heapq.heappush(waiting, (-len(rows[-1]), len(left) - 1))
            left[at], right[at] = len(left) - 2, len(left) - 1
        leaf = np.full(len(left), -1)
        leaf[np.flatnonzero(np.array(left) < 0)] = np.arange(sum(x < 0 for x in left))
        return cls(p, np.array(left), np.array(right), np.array(pivots), leaf)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearer pivot at every node."""
        node = np.zeros(len(x), dtype=np.int64)
        while len(moving := np.flatnonzero(self.left[node] >= 0)):
            l, r = self.left[node[moving]], self.right[node[moving]]
            nearer = norm(np.abs(x[moving] - self.pivots[l]), self.p) <= norm(np.abs(x[moving] - self.pivots[r]), self.p)
            node[moving] = np.where(nearer, l, r)
        return self.leaf[node]

    def centres(self) -> np.ndarray:
        """The pivots of the leaves, by number of the leaf."""
        nodes = np.flatnonzero(self.leaf >= 0)
        return self.pivots[nodes[np.argsort(self.leaf[nodes])]]

    def bounded(self, size: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> None:
        """Numbers, boxes and radii of the leaves' rows; inner nodes take the boxes of what is below them."""
        n, dims = len(self.left), self.pivots.shape[1]
        self.size, self.reach = np.zeros(n), np.full(n, np.inf)
        self.low, self.high = np.full((n, dims), np.inf), np.full((n, dims), -np.inf)
        nodes = np.flatnonzero(self.leaf >= 0)
        at = self.leaf[nodes]
        self.size[nodes], self.low[nodes], self.high[nodes], self.reach[nodes] = size[at], low[at], high[at], reach[at]
        for k in range(n - 1, -1, -1):  # children have higher numbers
            if self.left[k] >= 0:
                both = [self.left[k], self.right[k]]
                self.size[k] = self.size[both].sum()
                self.low[k], self.high[k] = self.low[both].min(axis=0), self.high[both].max(axis=0)

    def least(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """No row of `node` is nearer to x, one of each; infinite for a node without rows."""
        gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0.0)
        with np.errstate(invalid="ignore"):
            ball = norm(np.abs(x - self.pivots[node]), self.p) - self.reach[node]
        return np.where(self.size[node] > 0, np.maximum(norm(np.where(np.isfinite(gap), gap, np.inf), self.p), np.where(np.isnan(ball), 0.0, ball)), np.inf)

    def visits(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that may hold a row within `bound` of x."""
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        rows, leaves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(row):
            keep = np.empty(len(row), dtype=bool)
            for k in range(0, len(row), 65_536):
                part = slice(k, k + 65_536)
                keep[part] = self.least(x[row[part]], node[part]) <= bound[row[part]] * (1 + _SLACK) + _SLACK
            row, node = row[keep], node[keep]
            ends = self.left[node] < 0
            rows.append(row[ends])
            leaves.append(self.leaf[node[ends]])
            row, node = row[~ends], node[~ends]
            row, node = np.concatenate([row, row]), np.concatenate([self.left[node], self.right[node]])
        return np.concatenate(rows), np.concatenate(leaves)

    def enough(self, x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): each row's home, and more leaves, by the bound of their nearest place, until they hold `wanted` rows."""
        home = self.home(x)
        nodes = np.flatnonzero(self.leaf >= 0)
        of_leaf = nodes[np.argsort(self.leaf[nodes])]
        size = self.size[of_leaf]
        row, leaf = np.arange(len(x)), home
        rows, leaves = [row[size[home] > 0]], [home[size[home] > 0]]
        short = np.flatnonzero(size[home] < wanted)
        step = max(1, 2_000_000 // (len(of_leaf) * x.shape[1]))
        for k in range(0, len(short), step):
            some = short[k : k + step]
            far = self.least(np.repeat(x[some], len(of_leaf), axis=0), np.tile(of_leaf, len(some))).reshape(len(some), -1)
            far[np.arange(len(some)), home[some]] = -1.0
            order = far.argsort(axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            take = (before < wanted) & (size[order] > 0) & (order != home[some][:, None])
            at, which = np.nonzero(take)
            rows.append(some[at])
            leaves.append(order[at, which])
        return np.concatenate(rows), np.concatenate(leaves)
