"""Boosting that goes on from a running margin: what all losses share, and rounds of squared loss.

A round reads the margins that the last one left, so no round is trained or scored twice, however many
follow. The margins stay in the table of training and validation rows.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.models.forecaster import _FEATURES, _LABEL, Forecaster
from tidemill.session import cut_lineage

#: Rounds after which the margins go to a reliable checkpoint.
ROUNDS_BETWEEN_CHECKPOINTS = 5


class Margins:
    """Rows (`_x`, `_y`) of training and validation with their margin `_f`, as one table through all rounds."""

    def __init__(self, train: DataFrame, val: DataFrame | None, start: float):
        def begin(df: DataFrame, held_out: bool) -> DataFrame:
            return df.select("_x", F.col("_y").cast("double").alias("_y"), F.lit(start).alias("_f"), F.lit(held_out).alias("_val"))

        rows = begin(train, False)
        self.rows = cut_lineage(rows if val is None else rows.unionByName(begin(val, True)))
        self.rounds, self._held, self._last = 0, None, None

    @property
    def train(self) -> DataFrame:
        return self.rows.where(~F.col("_val"))

    def hold(self, scored: DataFrame) -> DataFrame:
        """Keeps what a round derives from the rows and reads more than once, in place of the last round's."""
        scored = scored.persist()
        self._last, self._held = self._held, scored
        return scored

    def advance(self, rows: DataFrame) -> None:
        """The margins after a round. `rows` derives from what `hold` keeps."""
        self.rounds += 1
        self.rows = rows.select("_x", "_y", "_f", "_val")
        if self.rounds % ROUNDS_BETWEEN_CHECKPOINTS == 0:
            self.rows = cut_lineage(self.rows)

    def release(self) -> None:
        """Drops what the round before held; call it once the present round's table has been read."""
        if self._last is not None:
            self._last.unpersist()
            self._last = None

    def losses(self, loss: Column) -> tuple[float | None, float | None]:
        """Mean loss of the training and of the validation rows at the present margins."""
        found = {r["_val"]: r["loss"] for r in self.rows.groupBy("_val").agg(F.avg(loss).alias("loss")).collect()}
        return found.get(False), found.get(True)

    def close(self) -> None:
        for table in (self._held, self._last):
            if table is not None:
                table.unpersist()
        self._held = self._last = None


class SquaredBoosting:
    """Rounds of a `GBTRegressor` one at a time: the trees, and losses, that its own fit of as many would give."""

    def __init__(self, settings: GBTRegressor, train: DataFrame, val: DataFrame | None = None):
        """`train`, `val`: rows with the vector `_x` and the label `_y`."""
        self.settings = settings
        self.margins = Margins(train, val, 0.0)
        self.trees, self.weights, self.history = [], [], []

    def _learner(self, round_: int) -> RandomForestRegressor:
        of = self.settings
        return RandomForestRegressor(
            featuresCol="_x",
            labelCol="_pull",
            predictionCol="_tree",
            numTrees=1,
            bootstrap=False,
            maxDepth=of.getMaxDepth(),
            maxBins=of.getMaxBins(),
            minInstancesPerNode=of.getMinInstancesPerNode(),
            minInfoGain=of.getMinInfoGain(),
            subsamplingRate=of.getSubsamplingRate(),
            featureSubsetStrategy=of.getFeatureSubsetStrategy(),
            seed=of.getSeed() + round_,
        )

    def add(self, rounds: int = 1) -> SquaredBoosting:
        """Appends rounds. The first tree fits the label with weight 1, later ones the gradient 2 (y - f)."""
        for _ in range(rounds):
            k = len(self.trees)
            pull = F.col("_y") if k == 0 else 2 * (F.col("_y") - F.col("_f"))
            tree = self._learner(k).fit(self.margins.train.withColumn("_pull", pull)).trees[0]
            weight = 1.0 if k == 0 else self.settings.getStepSize()
            tree.setFeaturesCol("_x").setPredictionCol("_tree")
            moved = tree.transform(self.margins.rows).withColumn("_f", F.col("_f") + weight * F.col("_tree"))
            self.margins.advance(self.margins.hold(moved.select("_x", "_y", "_f", "_val")))
            self.history.append((k + 1, *self.margins.losses((F.col("_y") - F.col("_f")) ** 2)))
            self.margins.release()
            self.trees.append(tree)
            self.weights.append(weight)
        return self

    def model(self, rounds: int) -> GBTRegressionModel:
        """The first `rounds` rounds as an MLlib model."""
        jvm, gateway = self.margins.rows.sparkSession._jvm, self.margins.rows.sparkSession.sparkContext._gateway
        kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
        trees, weights = gateway.new_array(kind, rounds), gateway.new_array(jvm.double, rounds)
        for k in range(rounds):
            trees[k], weights[k] = self.trees[k]._java_obj, float(self.weights[k])
        made = jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"GBTRegressor_{uuid.uuid4().hex[:12]}", trees, weights)
        return GBTRegressionModel(made)


def as_forecaster(prototype: Forecaster, boosting: SquaredBoosting, rounds: int) -> Forecaster:
    """`prototype`, fitted in its stages before the regressor, with the first `rounds` rounds as its regressor."""
    model = boosting.model(rounds)
    last = prototype.model.stages[-1]
    model.setFeaturesCol(last.getFeaturesCol()).setPredictionCol(last.getPredictionCol())
    prototype.model = PipelineModel([*prototype.model.stages[:-1], model])
    return prototype


def boosting_rows(prototype: Forecaster, df: DataFrame) -> DataFrame:
    """Rows with `_x` and `_y`, as the stages of a fitted prototype make them."""
    last = prototype.expand[-1].getOutputCol() if prototype.expand else _FEATURES
    return prototype.vectors(df).select(F.col(last).alias("_x"), F.col(_LABEL).alias("_y"))
