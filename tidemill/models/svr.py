"""Support vector regression: the loss that is 0 inside a tube, linear or with a kernel by landmarks.

The loss is rounded where it leaves the tube, over a width that shrinks from round to round; Newton steps then
need few passes. A pass adds up gradient and curvature in the tasks, and tasks meet in a tree, so what comes to
the driver is as many sums as there are pairs of features, whatever the number of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

#: The rounding of the loss as a share of the label's spread, from round to round.
_WIDTHS = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001)
#: Step lengths that one pass compares.
_STEPS = 0.5 ** np.arange(10)
#: Tables of sums that one task of the tree merges.
_FAN = 64


def tube_loss(residual: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slope, curvature) of max(0, |r| - epsilon), rounded over `width`."""
    over = np.abs(residual) - epsilon
    bent = (over > 0) & (over < width)
    loss = np.where(bent, over * over / (2 * width), np.where(over >= width, over - width / 2, 0.0))
    slope = np.sign(residual) * np.where(bent, over / width, (over >= width).astype(float))
    return loss, slope, bent / width


class EpsilonRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable):
    """Minimises |w|^2 / 2 + C sum max(0, |y - w x - b| - epsilon); the result is a `LinearRegressionModel`.

    Rows with a NULL label or vector take no part. `maxIter` bounds the Newton steps of each round.
    """

    C = Param(Params._dummy(), "C", "weight of the errors", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half the width of the tube", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, epsilon=0.1, maxIter=10):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, C=C, epsilon=epsilon, maxIter=maxIter)

    def setFeaturesCol(self, value: str) -> EpsilonRegression:
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> EpsilonRegression:
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str) -> EpsilonRegression:
        return self._set(predictionCol=value)

    def _fit(self, df: DataFrame) -> LinearRegressionModel:
        x, y = vector_to_array(F.col(self.getFeaturesCol())), F.col(self.getLabelCol()).cast("double")
        rows = df.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL").persist()
        try:
            weights = self._weights(rows)
        finally:
            rows.unpersist()
        jvm = df.sparkSession._jvm.org.apache.spark.ml
        vector = jvm.linalg.Vectors.dense(_doubles(df, weights[:-1]))
        made = jvm.regression.LinearRegressionModel(f"EpsilonRegression_{uuid.uuid4().hex[:12]}", vector, float(weights[-1]), 1.0)
        model = LinearRegressionModel(made)
        return model.setFeaturesCol(self.getFeaturesCol()).setPredictionCol(self.getPredictionCol())

    def _weights(self, rows: DataFrame) -> np.ndarray:
        """Weights of the features, and the intercept last."""
        n, size, mean, spread = rows.agg(F.count("y"), F.max(F.size("x")), F.avg("y"), F.stddev_pop("y")).first()
        if not n:
            raise ValueError("no row with a label and features")
        w = np.zeros(size + 1)
        w[-1] = mean
        ridge = np.append(np.full(size, 1.0 / (self.getOrDefault(self.C) * n)), 0.0)
        epsilon = self.getOrDefault(self.epsilon)
        for share in _WIDTHS:
            width = max(share * (spread or 1.0), 1e-12)
            for _ in range(self.getMaxIter()):
                sums = _summed(rows, lambda x, r, w=w, width=width: _newton_sums(x, r, w, epsilon, width), 1 + len(w) + len(w) ** 2) / n
                value = sums[0] + (ridge * w * w).sum() / 2
                gradient = sums[1 : 1 + len(w)] + ridge * w
                curve = sums[1 + len(w) :].reshape(len(w), len(w)) + np.diag(ridge)
                step = -np.linalg.lstsq(curve + 1e-10 * max(1e-12, np.trace(curve) / len(w)) * np.eye(len(w)), gradient, rcond=None)[0]
                if -gradient @ step < 1e-9 * max(1e-12, value):
                    break
                tried = w + _STEPS[:, None] * step
                losses = _summed(rows, lambda x, r, tried=tried, width=width: _losses(x, r, tried, epsilon, width), len(tried)) / n
                losses += (ridge * tried * tried).sum(axis=1) / 2
                best = int(np.argmin(losses))
                if losses[best] >= value:
                    break
                done, w = value - losses[best], tried[best]
                if done < 1e-9 * max(1e-12, value):
                    break
        return w


def _doubles(df: DataFrame, values: np.ndarray):
    out = df.sparkSession.sparkContext._gateway.new_array(df.sparkSession._jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out


def _newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, epsilon: float, width: float) -> np.ndarray:
    loss, slope, curve = tube_loss(y - x @ w, epsilon, width)
    return np.concatenate([[loss.sum()], -(slope @ x), ((x * curve[:, None]).T @ x).ravel()])


def _losses(x: np.ndarray, y: np.ndarray, tried: np.ndarray, epsilon: float, width: float) -> np.ndarray:
    return tube_loss(y[:, None] - x @ tried.T, epsilon, width)[0].sum(axis=0)


def _summed(rows: DataFrame, sums, size: int) -> np.ndarray:
    """Sums over all rows (with a 1 behind the features) of `sums(x, y)`, merged in a tree of tasks."""

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += sums(np.column_stack([flat, np.ones(len(flat))]), batch.column("y").to_numpy(zero_copy_only=False))
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for s in table.column("sums"):
            total += np.frombuffer(s.as_py())
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(add_up, "sums binary")
    tasks = rows.rdd.getNumPartitions() if rows.is_cached else _FAN
    while tasks > _FAN:
        tasks = -(-tasks // _FAN)
        parts = parts.groupBy((F.spark_partition_id() % tasks).alias("part")).applyInArrow(merge, "sums binary")
    return np.sum([np.frombuffer(r["sums"]) for r in parts.collect()], axis=0)


class NystromFeatures(Estimator, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Features whose products are the kernel exp(-gamma |x - y|^2) on, and near it between, `size` landmarks: rows
    picked by a seeded hash, without repeats.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of landmarks", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="_features", outputCol="_nystrom", gamma=0.1, size=128, seed=42):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, size=size, seed=seed)

    def _fit(self, df: DataFrame) -> NystromModel:
        rows = df.select(vector_to_array(F.col(self.getInputCol())).alias("x")).where("x IS NOT NULL").distinct()
        picked = rows.orderBy(F.xxhash64("x", F.lit(self.getSeed())), "x").limit(self.getOrDefault(self.size)).collect()
        return NystromModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), gamma=self.getOrDefault(self.gamma), landmarks=[list(r["x"]) for r in picked])


class NystromModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Kernel values to the landmarks, turned so that their products give the kernel again."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "rows of the kernel", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCol="_features", outputCol="_nystrom", gamma=0.1, landmarks=()):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, landmarks=[list(x) for x in landmarks])

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, marks = self.getOrDefault(self.gamma), np.array(self.getOrDefault(self.landmarks), dtype=float)

        def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            gap = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
            return np.exp(-gamma * np.maximum(gap, 0.0))

        values, vectors = np.linalg.eigh(kernel(marks, marks))
        kept = values > 1e-10 * values.max()
        turn = vectors[:, kept] / np.sqrt(values[kept])

        @F.pandas_udf("array<double>")
        def features(x: pd.Series) -> pd.Series:
            return pd.Series(list(kernel(np.stack(x.to_numpy()), marks) @ turn)) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(self.getOutputCol(), array_to_vector(features(vector_to_array(F.col(self.getInputCol())))))


def support_vectors(C: float = 1.0, epsilon: float = 0.1, max_iter: int = 10) -> EpsilonRegression:
    """Support vector regression by its usual names; with `NystromFeatures` in front it has a kernel."""
    return EpsilonRegression(C=C, epsilon=epsilon, maxIter=max_iter)
