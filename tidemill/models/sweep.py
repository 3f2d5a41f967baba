"""Exact nearest neighbours of a block of queries in a block of rows, where bounds leave out little.

All pairs are compared by a matrix product in single precision. It names the pairs that may be among the best, by
a bound on its own rounding; only these get their distance, from the vectors as they are.
"""

from __future__ import annotations

import numpy as np

from tidemill.models.metric_tree import norm

#: Queries and rows of one product; rows of the first one, which gives the first bounds; numbers compared at once.
_QUERIES, _ROWS, _FIRST, _AT_ONCE = 1_024, 4_096, 512, 4_000_000
#: Vectors beyond this are not centred; shorter distances than that may come out as 0.
_HUGE, _TINY = 1e150, 1e-150


def best_of_block(qx: np.ndarray, qid: np.ndarray, tx: np.ndarray, tid: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): the k nearest by Euclidean distance, ties to the row that stands first. Vectors with a
    non-finite component take no part, and distances that are not finite neither.
    """
    asked, rows = np.flatnonzero(np.isfinite(qx).all(axis=1)), np.flatnonzero(np.isfinite(tx).all(axis=1))
    near, found = np.full((len(qx), k), np.inf), np.full((len(qx), k), -1)
    if not len(asked) or not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    tx, tid, dims = tx[rows], tid[rows], tx.shape[1]
    largest = max(np.abs(tx).max(initial=0), np.abs(qx[asked]).max(initial=0))
    centre = tx.mean(axis=0) if largest < _HUGE else np.zeros(dims)
    scale = max(np.abs(tx - centre).max(initial=0), np.abs(qx[asked] - centre).max(initial=0)) or 1.0
    t = (tx - centre) / scale
    lengths = (t * t).sum(axis=1)
    most = np.sqrt(lengths.max())
    # q.t - |t|^2 / 2 orders the rows of a query as their distances do.
    t32 = np.concatenate([t, -lengths[:, None] / 2], axis=1).astype(np.float32)

    def gaps(at: np.ndarray, which: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            d = norm(np.abs(qx[at] - tx[which]), 2)
        if exclude_self:
            d[qid[at] == tid[which]] = np.inf
        return d

    def merge(at: np.ndarray, which: np.ndarray) -> None:
        """The best k of the pairs and of what was found before."""
        d = gaps(at, which)
        keep = np.isfinite(d) & (d <= near[at, -1])
        at, which, d = at[keep], which[keep], d[keep]
        if not len(at):
            return
        those = np.unique(at)
        before, had = np.repeat(those, k), found[those].ravel() >= 0
        at = np.concatenate([at, before[had]])
        d, which = np.concatenate([d, near[those].ravel()[had]]), np.concatenate([which, found[those].ravel()[had]])
        order = np.lexsort((which, d, at))
        at, which, d = at[order], which[order], d[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        near[those], found[those] = np.inf, -1
        first = rank < k
        near[at[first], rank[first]], found[at[first], rank[first]] = d[first], which[first]

    pairs = max(1, _AT_ONCE // dims)
    for i in range(0, len(asked), _QUERIES):
        some = asked[i : i + _QUERIES]
        q = (qx[some] - centre) / scale
        length = (q * q).sum(axis=1)
        slack = 4 * (dims + 16) * 2.0**-24 * (np.sqrt(length) * most + most**2 / 2 + length / 2) + 1e-30
        q32 = np.concatenate([q, np.ones((len(q), 1))], axis=1).astype(np.float32)
        take = min(len(tx), k + 1)
        width = min(len(tx), max(_FIRST, take))
        bound = np.full(len(some), np.inf)
        if take >= k:
            step = max(1, pairs // take)
            for a in range(0, len(some), step):
                near_by = q32[a : a + step] @ t32[:width].T
                pick = np.argpartition(near_by, width - take, axis=1)[:, width - take :]
                d = gaps(np.repeat(some[a : a + step], take), pick.ravel()).reshape(pick.shape)
                bound[a : a + step] = np.partition(d, k - 1, axis=1)[:, k - 1]
        begin = 0
        while begin < len(tx) and len(some):
            end = min(len(tx), begin + (width if not begin else _ROWS))
            with np.errstate(over="ignore", invalid="ignore"):
                least = (length - ((np.minimum(bound, near[some, -1]) + _TINY) / scale) ** 2) / 2 - slack
                least = (least - np.abs(least) * 2.0**-22).astype(np.float32)
            least[np.isnan(least)] = -np.inf
            at, which = np.nonzero(q32 @ t32[begin:end].T >= least[:, None])
            for a in range(0, len(at), pairs):
                merge(some[at[a : a + pairs]], which[a : a + pairs] + begin)
            begin = end
            # k rows at distance 0: all later rows stand behind them.
            open_ = near[some, -1] > 0
            if not open_.all():
                some, q32, length, slack, bound = some[open_], q32[open_], length[open_], slack[open_], bound[open_]
    at, which = np.nonzero(found >= 0)
    return at, rows[found[at, which]], near[at, which]
