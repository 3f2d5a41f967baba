"""Nearest neighbours by counting collisions of single projections, with virtual rehashing.

Each of `PROJECTIONS` random directions gives a sorted array of one block's vectors. A query opens a window
around its own projection in every array and widens all windows with a growing radius R: half a window is
`HALF_WIDTH` x R, so a vector at distance R lies in a window with a probability that does not depend on R.
A vector found in `THRESHOLD` of the windows or more is verified by its true distance, once. The search in
a block ends when the k-th nearest verified lies within R, or when all are verified; there is no cap on
candidates. Blocks hold a bounded number of rows and queries; every query meets every block, and the best k
of each block meet in the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 60
#: In units of R. A vector at distance R is in a window with probability 0.826.
HALF_WIDTH = 1.36
#: Share of the windows that make a candidate; 3 standard deviations below what distance R gives.
THRESHOLD = 0.68
#: Radii grow by this factor.
GROWTH = 1.2
#: Rows, and queries, that one task holds.
BLOCK_ROWS = 25_000
BLOCK_QUERIES = 10_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id and a vector that is not zero and has only finite components.

    Vectors of another length than the most frequent one (the longest of those) take no part either.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (dims["n"] if dims else 0))


def directions(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((PROJECTIONS, dim))


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        projected = self.vectors @ axes.T
        order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32)
        sorted_ = np.take_along_axis(projected.T, order, axis=1)
        self.step = max(float(np.median(projected.std(axis=0))) / 20, 1e-12)
        # All arrays in one, array j scaled into [2j, 2j + 1], so that one search opens all windows.
        self.low, self.high = sorted_[:, :1], sorted_[:, -1:]
        self.reach = np.where(self.high > self.low, self.high - self.low, 1.0)
        self.order, self.sorted = order.ravel(), self._scaled(sorted_).ravel()

    def _scaled(self, at: np.ndarray) -> np.ndarray:
        return (at - self.low) / self.reach + 2.0 * np.arange(len(at))[:, None]

    def _places(self, at: np.ndarray) -> np.ndarray:
        """The place in `sorted` of one value per projection, inside that projection's own array."""
        n, at = len(self.ids), at[:, None]
        own = np.arange(len(at)) * n
        found = np.clip(np.searchsorted(self.sorted, self._scaled(np.clip(at, self.low, self.high))[:, 0]), own, own + n)
        return np.where((at > self.high)[:, 0], own + n, found)

    def nearest(self, query: np.ndarray, own: int, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest found, nearest first, ties by id. `at`: the query's projections."""
        n = len(self.ids)
        counts = np.zeros(n, dtype=np.int16)
        low = high = self._places(at)
        fresh = self.ids != own
        needed = math.ceil(THRESHOLD * len(at))
        found, distances, radius = np.empty(0, np.int64), np.empty(0), self.step
        while True:
            lower, upper = np.minimum(self._places(at - HALF_WIDTH * radius), low), np.maximum(self._places(at + HALF_WIDTH * radius), high)
            ends = zip([*lower, *high], [*low, *upper])
            counts += np.bincount(np.concatenate([self.order[a:b] for a, b in ends]), minlength=n)
            low, high = lower, upper
            new = np.flatnonzero(((counts >= needed) | (not math.isfinite(radius))) & fresh)
            if len(new):
                fresh[new] = False
                apart = np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))
                found, distances = np.concatenate([found, new]), np.concatenate([distances, apart])
                best = np.lexsort((self.ids[found], distances))[:k]
                found, distances = found[best], distances[best]
            if (len(found) >= k and distances[-1] <= radius) or not fresh.any():
                return self.ids[found], distances
            radius *= GROWTH


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query row, by Euclidean distance.

    `queries` picks query rows by columns id and v. A query's candidates are all usable rows with another
    id. Repeated query rows count once. A query gives fewer than k rows only if there are fewer
    candidates; empty tables give no rows. Other columns are not read.
    """
    schema = "query_id long, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    asked = rows.filter(queries).dropDuplicates(["id"])
    n, first, m = rows.count(), rows.first(), asked.count()
    if first is None or not m:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    axes = directions(len(first["v"]), seed)
    blocks, chunks = math.ceil(n / BLOCK_ROWS), math.ceil(m / BLOCK_QUERIES)
    # Any even deal will do: a block's answers do not hang on which rows share it.
    dealt = rows.withColumn("block", (F.monotonically_increasing_id() % blocks).cast("int"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = t.column("v").combine_chunks()
        return t.column("id").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block = Block(*matrix(left), axes)
            ids, points = matrix(right)
            for i, point, at in zip(ids.tolist(), points, points @ axes.T):
                near, apart = block.nearest(point, i, at, k)
                out.append((np.full(len(near), i), near, apart))
        columns = [np.concatenate(c) if out else np.empty(0, d) for c, d in zip(zip(*out) if out else ((),) * 3, (np.int64, np.int64, np.float64))]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    found = dealt.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
