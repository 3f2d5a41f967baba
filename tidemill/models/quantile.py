"""Quantile forecasts: boosted trees on pinball loss, and residual intervals."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.models.boosting import Margins
from tidemill.models.forecaster import PREDICTION
from tidemill.models.search import draw, search, search_in_turn
from tidemill.operators.buckets import join_same
from tidemill.operators.metrics import pinball, pinball_loss
from tidemill.operators.quantiles import exact_quantiles

# Name -> probability of the three forecasts (a 98 % interval and the median).
QUANTILES = {"lower": 0.01, "median": 0.5, "upper": 0.99}
# Ranges of the sampled search.
SPACE = {
    "max_depth": ("int", 3, 10),
    "learning_rate": ("log", 0.01, 0.3),
    "subsample": ("real", 0.6, 1.0),
    "colsample_bytree": ("real", 0.6, 1.0),
    "min_child_weight": ("int", 1, 10),
    "gamma": ("real", 0.0, 5.0),
}
_META = (
    "features array<string>, target string, q double, learning_rate double, colsample_bytree double, random_state int, "
    "start double, leaves array<map<double, double>>"
)


@dataclass
class QuantileBoosting:
    """Gradient boosting for one quantile, with the contract of `Forecaster`.

    Each round fits an MLlib tree to the sign of the residuals, then sets every leaf to the
    exact quantile of its residuals. Leaf values (at most 2^max_depth numbers) are literals in the
    scoring expression, so scoring needs no join. Columns are sampled per tree.
    """

    features: Sequence[str]
    target: str
    q: float
    n_estimators: int = 100
    max_depth: int = 3
    learning_rate: float = 0.1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    min_child_weight: int = 1
    gamma: float = 0.0
    random_state: int = 42
    patience: int | None = None
    start: float = 0.0
    trees: list = field(default_factory=list)
    leaves: list = field(default_factory=list)
    losses: list = field(default_factory=list)
    best_iteration: int = 0

    def _assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(self.features), outputCol="_x").transform(df)

    def _columns(self, round_: int) -> list[int]:
        n = len(self.features)
        take = max(1, round(self.colsample_bytree * n))
        return sorted(random.Random(self.random_state + round_).sample(range(n), take))

    def _with_leaf(self, df: DataFrame, tree, round_: int) -> DataFrame:
        sliced = VectorSlicer(inputCol="_x", outputCol="_xs", indices=self._columns(round_)).transform(df)
        return tree.transform(sliced).drop("_xs", "_tree")

    def _moved(self, df: DataFrame, values: Mapping[float, float], into: str) -> DataFrame:
        pairs = [F.lit(part) for item in sorted(values.items()) for part in item]
        leaf = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_leaf")), F.lit(0.0))
        return df.withColumn(into, F.col(into) + self.learning_rate * leaf).drop("_leaf")

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> QuantileBoosting:
        """With `val` and `patience`, stops once that many rounds bring no better loss on it.

        A round scores the rows once: its leaf quantiles and the next residuals read the same cached table.
        """
        y = F.col(self.target).cast("double")
        n = train.count()
        self.start = exact_quantiles(train, [], self.target, {"q": self.q}, most_rows=n).first()["q"]
        self.trees, self.leaves, self.losses, self.best_iteration = [], [], [], 0

        def rows_of(df: DataFrame) -> DataFrame:
            return self._assemble(df.select(*self.features, self.target)).select("_x", y.alias("_y"))

        margins = Margins(rows_of(train), None if val is None else rows_of(val), self.start)
        pull = F.when(F.col("_y") > F.col("_f"), self.q).otherwise(self.q - 1)
        best = float("inf")
        try:
            for i in range(self.n_estimators):
                learner = DecisionTreeRegressor(
                    featuresCol="_xs",
                    labelCol="_pull",
                    predictionCol="_tree",
                    leafCol="_leaf",
                    maxDepth=self.max_depth,
                    minInstancesPerNode=self.min_child_weight,
                    minInfoGain=self.gamma,
                    seed=self.random_state + i,
                )
                rows = VectorSlicer(inputCol="_x", outputCol="_xs", indices=self._columns(i)).transform(margins.train)
                rows = rows.select("_xs", pull.alias("_pull"))
                tree = learner.fit(rows if self.subsample >= 1 else rows.sample(self.subsample, seed=self.random_state + i))
                scored = margins.hold(self._with_leaf(margins.rows, tree, i))
                residuals = scored.where(~F.col("_val")).select("_leaf", (F.col("_y") - F.col("_f")).alias("_r"))
                table = exact_quantiles(residuals, ["_leaf"], "_r", {"v": self.q}, most_rows=n).collect()
                margins.release()
                values = {row["_leaf"]: row["v"] for row in table}
                self.trees.append(tree)
                self.leaves.append(values)
                margins.advance(self._moved(scored, values, "_f"))
                if val is not None:
                    losses = margins.losses(pinball_loss("_y", "_f", self.q))
                    self.losses.append((i + 1, *losses))
                    if losses[1] is not None and losses[1] < best:
                        best, self.best_iteration = losses[1], i + 1
                    elif self.patience is not None and i + 1 - self.best_iteration >= self.patience:
                        break
        finally:
            margins.close()
        if val is None:
            self.best_iteration = len(self.trees)
        return self

    def predict(self, df: DataFrame, name: str = PREDICTION) -> DataFrame:
        """Rows with the quantile in `name`, from the rounds up to the best one."""
        out = self._assemble(df).withColumn(name, F.lit(self.start))
        for i in range(self.best_iteration):
            out = self._moved(self._with_leaf(out, self.trees[i], i), self.leaves[i], name)
        return out.drop("_x")

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Pinball loss, and the share of rows below the forecast (near q if calibrated)."""
        below = F.avg((F.col(self.target) <= F.col(PREDICTION)).cast("int"))
        return self.predict(df).agg(pinball(self.target, PREDICTION, self.q).alias("pinball"), below.alias("share_below"))

    def save(self, spark: SparkSession, path: str) -> None:
        """The trees up to the best round, and their leaf values."""
        kept = range(self.best_iteration)
        PipelineModel([self.trees[i] for i in kept]).write().overwrite().save(f"{path}/trees")
        leaves = [{float(k): float(v) for k, v in self.leaves[i].items()} for i in kept]
        row = (list(self.features), self.target, float(self.q), float(self.learning_rate), float(self.colsample_bytree), self.random_state, float(self.start), leaves)
        spark.createDataFrame([row], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantileBoosting:
        meta = spark.read.parquet(f"{path}/meta").first()
        out = cls(meta["features"], meta["target"], meta["q"], learning_rate=meta["learning_rate"], colsample_bytree=meta["colsample_bytree"], random_state=meta["random_state"], start=meta["start"])
        out.trees, out.leaves = PipelineModel.load(f"{path}/trees").stages, meta["leaves"]
        out.best_iteration = out.n_estimators = len(out.trees)
        return out


def fit_interval(train: DataFrame, features: Sequence[str], target: str, params: Mapping[str, Mapping] | None = None, val=None, **common):
    """One model per quantile, fitted at the same time; `params` may override settings per name (lower, median, upper)."""
    params = params or {}

    def one(name: str) -> QuantileBoosting:
        return QuantileBoosting(features, target, QUANTILES[name], **{**common, **params.get(name, {})}).fit(train, val)

    with ThreadPool(len(QUANTILES)) as pool:
        return dict(zip(QUANTILES, pool.map(one, QUANTILES, chunksize=1)))


def predict_interval(models: Mapping[str, QuantileBoosting], df: DataFrame) -> DataFrame:
    """Rows of `df` with columns lower, median, upper."""
    for name, model in models.items():
        df = model.predict(df, name)
    return df


def save_interval(models: Mapping[str, QuantileBoosting], spark: SparkSession, path: str) -> None:
    for name, model in models.items():
        model.save(spark, f"{path}/{name}")


def load_interval(spark: SparkSession, path: str) -> dict[str, QuantileBoosting]:
    return {name: QuantileBoosting.load(spark, f"{path}/{name}") for name in QUANTILES}


def tune_interval(
    rows: DataFrame,
    time: str,
    tie: Sequence[str],
    features: Sequence[str],
    target: str,
    space: Mapping[str, tuple] = SPACE,
    n_iter: int = 50,
    n_splits: int = 5,
    n_estimators: int = 1000,
    seed: int = 42,
    in_turn: bool = False,
) -> dict[str, dict]:
    """Best settings per quantile by pinball loss over expanding folds, from `n_iter` seeded draws of `space`.

    `in_turn`: draws are conditioned on the losses of those before (`search.ParzenDraws`).

    The result can be stored with `search.store_params` and goes into `fit_interval` as `params`, usually
    with a validation table, more rounds and a patience (3,000 and 200).
    """
    found = {}
    for name, q in QUANTILES.items():

        def make(p: dict, q=q) -> QuantileBoosting:
            return QuantileBoosting(features, target, q, n_estimators=n_estimators, **p)

        def loss(predicted: DataFrame, q=q) -> float:
            return predicted.agg(pinball(target, PREDICTION, q)).first()[0]

        if in_turn:
            result = search_in_turn(rows, time, tie, make, space, n_iter, seed=seed, refit="pinball", n_splits=n_splits, score=loss)
        else:
            result = search(rows, time, tie, make, draw(space, n_iter, seed), n_splits=n_splits, refit="pinball", score=loss)
        found[name] = result.best_params
    return found


def residual_interval(
    history: DataFrame, future: DataFrame, y: str, yhat: str, by: str, q_low: float = 0.01, q_high: float = 0.99
) -> DataFrame:
    """Interval around a point forecast from the quantiles of past errors per `by` value."""
    errors = history.withColumn("_r", F.col(y) - F.col(yhat))
    bands = exact_quantiles(errors, [by], "_r", {"_low": q_low, "_high": q_high})
    return join_same(future, bands, [by], "left").withColumns(
        {"lower": F.col(yhat) + F.col("_low"), "upper": F.col(yhat) + F.col("_high")}
    ).drop("_low", "_high")
