"""Exact k-nearest-neighbour regression with a metric tree, as Spark joins on the tree's leaves.

Where the tree leaves out little, as for vectors of many even dimensions, blocks of queries meet blocks of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemill.models.forecaster import PREDICTION
from tidemill.models.metric_tree import MAX_LEAVES, SAMPLE_ROWS, MetricTree, distances, norm
from tidemill.models.sweep import best_of_block
from tidemill.operators.metrics import point_metrics
from tidemill.sources.tables import kept

#: Rows of a block: what one task compares queries with, and queries it takes at once.
ROWS_PER_CHUNK = 20_000
#: Rows of a block below which more tasks do not pay.
LEAST_CHUNK = 1_000
#: Rows of a leaf, in expectation: `ROWS_PER_LEAF`, or one per dimension if that is more. Rows that the first pass
#: compares a query with.
ROWS_PER_LEAF, NEAR_ROWS = 8, 256
#: Part of all pairs from which the tree is left for products of blocks, and sample rows and neighbours that tell it.
MUCH, TRIED_ROWS, TRIED_NEAR = 0.2, 32, 5
_META = "features array<string>, target string, id_col string, k int, weights string, p double"


def _vector(features: Sequence[str] | str) -> Column:
    """One array column, or several numeric columns."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 1))


def _usable(df: DataFrame, id_col: str) -> DataFrame:
    return df.where(df[id_col].isNotNull() & df["_x"].isNotNull() & ~F.exists("_x", F.isnull))


def _by_block(row: np.ndarray, leaf: np.ndarray, n: int, first: np.ndarray, parts: np.ndarray) -> pd.Series:
    """For each of n queries its visits: a block and the leaves in it. `first`, `parts`: a leaf's blocks."""
    out: list[list[dict]] = [[] for _ in range(n)]
    order = np.lexsort((leaf, first[leaf], row))
    row, leaf = row[order], leaf[order]
    block = first[leaf]
    cuts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else []
    for begin, end in zip(cuts, [*cuts[1:], len(row)]):
        for k in range(int(parts[leaf[begin]])):
            out[row[begin]].append({"block": int(block[begin]) + k, "leaves": leaf[begin:end].tolist()})
    return pd.Series(out, dtype=object)


def visited_part(tree: MetricTree, sample: np.ndarray) -> float:
    """Which part of the sample its rows visit, on the mean, for their nearest rows in it."""
    sample = sample[np.isfinite(sample).all(axis=1)]
    if not len(sample) or not np.isfinite(tree.pivots).all():
        return 1.0
    leaf = tree.home(sample)
    size, reach = np.bincount(leaf, minlength=tree.leaves), np.zeros(tree.leaves)
    low, high = (np.full((tree.leaves, sample.shape[1]), x) for x in (np.inf, -np.inf))
    np.maximum.at(reach, leaf, norm(np.abs(sample - tree.centres()[leaf]), tree.p))
    np.minimum.at(low, leaf, sample)
    np.maximum.at(high, leaf, sample)
    tree.bounded(size, low, high, reach)
    some = sample[:: -(-len(sample) // TRIED_ROWS)]
    at = min(TRIED_NEAR, len(sample) - 1)
    bound = np.partition(distances(some, sample, tree.p), at, axis=1)[:, at]  # itself, and its nearest
    return float(size[tree.visits(some, bound)[1]].sum() / (len(some) * len(sample)))


class NeighbourIndex:
    """The rows of a table in the leaves of a metric tree, stored once for any number of searches.

    Building it reads the table three times: to count, to sample, and to place all rows; the placed rows go to
    the shared folder. The tree (at most `MAX_LEAVES` leaves) and the leaves' bounds are all that the
    driver holds. Rows without an id, a vector or one of its components are left out. Where p is 2 and rows of the sample
    visit over `MUCH` of it, the rows are stored as they are, and a search compares all pairs by products of blocks.
    """

    def __init__(self, train: DataFrame, features: Sequence[str] | str, id_col: str, target: str, p: float = 2, rows_per_chunk: int = ROWS_PER_CHUNK):
        self.features, self.id_col, self.p = features, id_col, p
        self.id_type = train.schema[id_col].dataType.simpleString()
        self.spark = train.sparkSession
        known = _usable(train.select(F.col(id_col).alias("_tid"), _vector(features).alias("_x"), F.col(target).cast("double").alias("_y")), "_tid")
        picked = known.orderBy(F.xxhash64("_tid"), "_tid").limit(SAMPLE_ROWS).select("_x").collect()
        self.n = len(picked) if len(picked) < SAMPLE_ROWS else known.count()
        if not self.n:
            return
        cores = self.spark.sparkContext.defaultParallelism
        self.rows_per_chunk = min(rows_per_chunk, max(LEAST_CHUNK, math.ceil(self.n / cores)))
        per_leaf = min(max(ROWS_PER_LEAF, len(picked[0]["_x"])), max(1, rows_per_chunk))
        self.tree = tree = MetricTree.shaped(np.array([r["_x"] for r in picked], dtype=float), min(MAX_LEAVES, max(1, self.n // per_leaf)), p)
        self.sweeps = p == 2 and visited_part(tree, np.array([r["_x"] for r in picked], dtype=float)) > MUCH
        if self.sweeps:
            self.rows_per_chunk, self.rows = rows_per_chunk, kept(known, "neighbours")
            return
        centres = tree.centres()

        @F.pandas_udf("leaf int, reach double")
        def place(x: pd.Series) -> pd.DataFrame:
            if not len(x):
                return pd.DataFrame({"leaf": np.empty(0, np.int32), "reach": np.empty(0)})
            rows = _stack(x)
            leaf = tree.home(rows)
            return pd.DataFrame({"leaf": leaf.astype(np.int32), "reach": norm(np.abs(rows - centres[leaf]), p)})

        placed = kept(known.withColumn("_place", place("_x")).select("_tid", "_x", "_y", "_place.leaf", "_place.reach"), "neighbours")
        self._bound(placed)
        self._block(placed)

    def _bound(self, placed: DataFrame) -> None:
        tree, dims = self.tree, self.tree.pivots.shape[1]

        def tight(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            size, reach = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves)
            low, high = np.full((tree.leaves, dims), np.inf), np.full((tree.leaves, dims), -np.inf)
            for rows in batches:
                if len(rows):
                    leaf, x = rows["leaf"].to_numpy(), _stack(rows["_x"])
                    np.add.at(size, leaf, 1)
                    np.maximum.at(reach, leaf, rows["reach"].to_numpy())
                    np.minimum.at(low, leaf, x)
                    np.maximum.at(high, leaf, x)
            used = np.flatnonzero(size)
            sides = {"low": low[used].ravel(), "high": high[used].ravel(), "n": np.repeat(size[used], dims), "reach": np.repeat(reach[used], dims)}
            yield pd.DataFrame({"leaf": np.repeat(used, dims).astype(np.int32), "at": np.tile(np.arange(dims, dtype=np.int32), len(used)), **sides})

        # A row per task, leaf and dimension; the tasks' rows meet in Spark.
        parts = placed.select("leaf", "reach", "_x").mapInPandas(tight, "leaf int, at int, low double, high double, n long, reach double")
        size, reach = np.zeros(tree.leaves), np.zeros(tree.leaves)
        low, high = np.full((tree.leaves, dims), np.inf), np.full((tree.leaves, dims), -np.inf)
        for r in parts.groupBy("leaf", "at").agg(F.min("low"), F.max("high"), F.sum("n"), F.max("reach")).collect():
            leaf, at, low[leaf, at], high[leaf, at], size[leaf], reach[leaf] = r
        tree.bounded(size, low, high, reach)
        self.leaf_size = size.astype(np.int64)

    def _block(self, placed: DataFrame) -> None:
        """Neighbouring leaves share a block of about `rows_per_chunk` rows; a larger leaf is cut into several."""
        tree, order, stack = self.tree, [], [0]
        while stack:  # leaves from left to right
            node = stack.pop()
            if tree.left[node] < 0:
                order.append(tree.leaf[node])
            else:
                stack += [tree.right[node], tree.left[node]]
        self.first, self.parts = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64)
        block, held = 0, 0
        for leaf in order:
            n = int(self.leaf_size[leaf])
            if held and held + n > self.rows_per_chunk:
                block, held = block + 1, 0
            self.first[leaf], self.parts[leaf] = block, max(1, -(-n // self.rows_per_chunk))
            block, held = (block + self.parts[leaf], 0) if self.parts[leaf] > 1 else (block, held + n)

        first, parts = (F.array(*[F.lit(int(v)) for v in x]) for x in (self.first, self.parts))
        part = F.pmod(F.xxhash64("_tid"), F.element_at(parts, F.col("leaf") + 1))
        self.rows = placed.select("_tid", "_x", "_y", "leaf", (F.element_at(first, F.col("leaf") + 1) + part).cast("int").alias("block"))

    def _search(self, asked: DataFrame, k: int, exclude_self: bool, dealt: bool) -> DataFrame:
        """(_qid, _tid, distance, _y): the best k of each block that a query (_qid, _x, bound, block, leaves) visits."""
        left, right = asked.withColumn("salt", F.lit(0)), self.rows.withColumn("salt", F.lit(0))
        if dealt:
            # Blocks that many queries visit are read by several tasks.
            salts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / self.rows_per_chunk).cast("int").alias("salts"))
            left = asked.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("_qid"), F.col("salts")).cast("int")).drop("salts")
            right = self.rows.join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        p = self.p

        def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({"_qid": q["_qid"].iloc[:0], "_tid": t["_tid"].iloc[:0], "distance": [], "_y": []})
            if q.empty or t.empty:
                return empty
            t = t.sort_values(["leaf", "_tid"])
            leaf, tid, ty, tx = t["leaf"].to_numpy(), t["_tid"].to_numpy(), t["_y"].to_numpy(), _stack(t["_x"])
            qid, qx, bound = q["_qid"].to_numpy(), _stack(q["_x"]), q["bound"].to_numpy().copy()
            at = np.repeat(np.arange(len(q)), [len(x) for x in q["leaves"]])
            wanted = np.concatenate([np.asarray(x, dtype=np.int64) for x in q["leaves"]])
            order = np.argsort(wanted, kind="stable")
            at, wanted = at[order], wanted[order]
            numbers, of_leaf = np.unique(leaf, return_inverse=True)
            visited = None
            if 2 * len(wanted) > len(q) * len(numbers):  # most leaves for most queries: all rows at once
                visited = np.zeros((len(q), len(numbers)), dtype=bool)
                here = np.isin(wanted, numbers)
                visited[at[here], np.searchsorted(numbers, wanted[here])] = True
                leaf, at, wanted = np.zeros(len(leaf), np.int64), np.arange(len(q)), np.zeros(len(q), np.int64)
            code = pd.factorize(tid, sort=True)[0]  # order of the ids, of whatever type
            near = np.full((len(q), k), np.inf)
            found = np.full((len(q), k), -1)
            for one in np.unique(wanted):
                low, high = np.searchsorted(leaf, [one, one + 1])
                queries = at[slice(*np.searchsorted(wanted, [one, one + 1]))]
                for i in range(0, len(queries), step := max(1, 1_000_000 // max(1, (high - low) * qx.shape[1]))):
                    some = queries[i : i + step]
                    d = distances(qx[some], tx[low:high], p)
                    if exclude_self:
                        d[qid[some][:, None] == tid[None, low:high]] = np.inf
                    d[d > bound[some][:, None]] = np.inf
                    if visited is not None:
                        d[~visited[some][:, of_leaf]] = np.inf
                    merged = np.concatenate([near[some], d], axis=1)
                    names = np.concatenate([found[some], np.broadcast_to(np.arange(low, high), d.shape)], axis=1)
                    pick = np.lexsort((code[names], merged), axis=1)[:, :k]
                    near[some], found[some] = np.take_along_axis(merged, pick, axis=1), np.take_along_axis(names, pick, axis=1)
                    bound[some] = np.minimum(bound[some], near[some][:, -1])
            row, which = np.nonzero(np.isfinite(near))
            hit = found[row, which]
            return pd.DataFrame({"_qid": qid[row], "_tid": tid[hit], "distance": near[row, which], "_y": ty[hit]})

        schema = f"_qid {asked.schema['_qid'].dataType.simpleString()}, _tid {self.id_type}, distance double, _y double"
        return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInPandas(best, schema)

    def _visits(self, asked: DataFrame, wanted: int, far: bool) -> DataFrame:
        """Queries with the blocks to visit: those near by that hold `wanted` rows, or (`far`) all others within `bound`."""
        tree, first_block, parts = self.tree, self.first, self.parts

        @F.pandas_udf("array<struct<block: int, leaves: array<int>>>")
        def visit(x: pd.Series, bound: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = _stack(x)
            row, leaf = tree.enough(rows, wanted)
            if far:
                seen = row * tree.leaves + leaf
                row, leaf = tree.visits(rows, bound.to_numpy())
                new = ~np.isin(row * tree.leaves + leaf, seen)
                row, leaf = row[new], leaf[new]
            return _by_block(row, leaf, len(rows), first_block, parts)

        visits = asked.withColumn("_visit", F.explode(visit("_x", "bound")))
        return visits.select("_qid", "_x", "bound", "_visit.block", "_visit.leaves")

    def neighbours(self, query: DataFrame, k: int = 5, exclude_self: bool = False) -> DataFrame:
        """(query id, neighbour, distance, neighbour_target): the k nearest, ties by id. See `nearest`."""
        asked_type = query.schema[self.id_col].dataType.simpleString()
        if not self.n:
            return self.spark.createDataFrame([], f"`{self.id_col}` {asked_type}, neighbour {self.id_type}, distance double, neighbour_target double")
        best = self._sweep(query, k, exclude_self) if self.sweeps else self._two_passes(query, k, exclude_self)[0]
        return best.select(F.col("_qid").alias(self.id_col), F.col("_tid").alias("neighbour"), "distance", F.col("_y").alias("neighbour_target"))

    def visited_pairs(self, query: DataFrame, k: int = 5, exclude_self: bool = False) -> int:
        """How many (query, row) distances a search takes."""
        if self.sweeps:
            return self._asked(query).count() * self.n
        size = F.array(*[F.lit(int(n)) for n in self.leaf_size])
        _, visits = self._two_passes(query, k, exclude_self)
        pairs = F.aggregate("leaves", F.lit(0).cast("long"), lambda a, leaf: a + F.element_at(size, leaf + 1))
        once = visits.groupBy("_qid", "leaves").agg(F.first(pairs).alias("pairs"))  # a large leaf has several blocks
        return once.agg(F.sum("pairs")).first()[0] or 0

    def _asked(self, query: DataFrame) -> DataFrame:
        return _usable(query.select(F.col(self.id_col).alias("_qid"), _vector(self.features).alias("_x")), "_qid").dropDuplicates(["_qid"])

    def _sweep(self, query: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """(_qid, _tid, distance, _y): the best k, each block of queries compared with each block of rows."""
        asked = self._asked(query)
        many = max(1, asked.count())
        even = math.ceil(math.sqrt(self.n * many / (3 * self.spark.sparkContext.defaultParallelism)))
        width = min(self.rows_per_chunk, max(LEAST_CHUNK, even))
        blocks, sides = math.ceil(self.n / width), math.ceil(many / width)
        left = asked.withColumn("side", F.pmod(F.xxhash64("_qid"), F.lit(sides)).cast("int"))
        right = self.rows.withColumn("block", F.pmod(F.xxhash64("_tid", "_x"), F.lit(blocks)).cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = right.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))

        def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if q.empty or t.empty:
                return pd.DataFrame({"_qid": q["_qid"].iloc[:0], "_tid": t["_tid"].iloc[:0], "distance": [], "_y": []})
            t = t.sort_values("_tid")
            qid, tid, ty = q["_qid"].to_numpy(), t["_tid"].to_numpy(), t["_y"].to_numpy()
            row, hit, distance = best_of_block(_stack(q["_x"]), qid, _stack(t["_x"]), tid, k, exclude_self)
            return pd.DataFrame({"_qid": qid[row], "_tid": tid[hit], "distance": distance, "_y": ty[hit]})

        schema = f"_qid {asked.schema['_qid'].dataType.simpleString()}, _tid {self.id_type}, distance double, _y double"
        return self._top(left.groupBy("block", "side").cogroup(right.groupBy("block", "side")).applyInPandas(best, schema), k)

    def _two_passes(self, query: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
        asked = self._asked(query)
        # A query visits a block once, so few queries fill no block; many are stored with their visits.
        dealt = asked.count() > self.rows_per_chunk
        wanted = max(NEAR_ROWS, k + 1)
        near = self._visits(asked.withColumn("bound", F.lit(float("inf"))), wanted, far=False)
        near = kept(near, "near-visits") if dealt else near
        first = kept(self._top(self._search(near, k, exclude_self, dealt), k), "near-rows")
        worst = F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(float("inf")).alias("bound")
        again = asked.join(first.groupBy("_qid").agg(worst), "_qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        far = self._visits(again, wanted, far=True)
        far = kept(far, "far-visits") if dealt else far
        return self._top(first.unionByName(self._search(far, k, exclude_self, dealt)), k), near.unionByName(far)

    @staticmethod
    def _top(pairs: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("_qid").orderBy("distance", "_tid"))
        return pairs.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def nearest(
    train: DataFrame,
    query: DataFrame,
    features: Sequence[str] | str,
    id_col: str,
    target: str,
    k: int = 5,
    p: float = 2,
    exclude_self: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """(query id, neighbour id, distance, neighbour target): the k nearest, ties by id.

    `exclude_self`: a row is not its own neighbour (leave-one-out on one table). Rows without an id, a vector
    or one of its components have no distance: they are no neighbours and find none; a query id that repeats
    is asked once. Small tables are cut finer than `rows_per_chunk`, so that every core has a group; the
    result is the same. Runs jobs when called; build a `NeighbourIndex` for more than one search.
    """
    return NeighbourIndex(train, features, id_col, target, p, rows_per_chunk).neighbours(query, k, exclude_self)


def uniform_mean() -> Column:
    """Plain mean of the neighbours' targets, for use per query id."""
    return F.avg("neighbour_target")


def distance_mean() -> Column:
    """Mean weighted by 1/distance; if any distance is 0 only those rows count."""
    zero = F.col("distance") == 0
    w = F.when(~zero, 1 / F.col("distance"))
    weighted = F.sum(w * F.col("neighbour_target")) / F.sum(w)
    return F.coalesce(F.avg(F.when(zero, F.col("neighbour_target"))), weighted)


def knn_predict(neighbours: DataFrame, id_col: str, weights: str = "uniform") -> DataFrame:
    """(id, prediction); weights: uniform or distance."""
    mean = uniform_mean() if weights == "uniform" else distance_mean()
    return neighbours.groupBy(id_col).agg(mean.alias("prediction"))


class NeighbourForecaster:
    """k-NN regression with the contract of `Forecaster`: fit keeps the rows, predict searches them.

    `id_col` names a row, in training and in scored tables; it settles equal distances. Rows without an id
    or a feature get no prediction. Features should be scaled before.
    """

    def __init__(self, features: Sequence[str], target: str, id_col: str, k: int = 5, weights: str = "uniform", p: float = 2):
        if weights not in ("uniform", "distance"):
            raise ValueError("weights: uniform or distance")
        self.features, self.target, self.id_col = list(features), target, id_col
        self.k, self.weights, self.p = k, weights, p
        self.rows: DataFrame | None = None
        self._index: NeighbourIndex | None = None

    def fit(self, df: DataFrame) -> NeighbourForecaster:
        """Keeps the rows; their index is built by the first prediction and serves all later ones."""
        self.rows, self._index = df.select(self.id_col, *self.features, self.target), None
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self._index is None:
            self._index = NeighbourIndex(self.rows, self.features, self.id_col, self.target, self.p)
        near = self._index.neighbours(df, self.k)
        return df.join(knn_predict(near, self.id_col, self.weights), self.id_col, "left")

    def evaluate(self, df: DataFrame, scores=("rmse", "mae", "mape", "sd")) -> DataFrame:
        return point_metrics(self.predict(df), self.target, PREDICTION, scores=scores)

    def save(self, spark: SparkSession, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        row = (self.features, self.target, self.id_col, self.k, self.weights, float(self.p))
        spark.createDataFrame([row], _META).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourForecaster:
        meta = spark.read.schema(_META).json(f"{path}/meta").first()
        return cls(*meta).fit(spark.read.parquet(f"{path}/rows"))
