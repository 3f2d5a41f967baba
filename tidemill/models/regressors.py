"""MLlib regressors by their usual parameter names."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

# The deepest tree MLlib grows; stands for "no limit".
MAX_DEPTH = 30


def _feature_share(share) -> str:
    """sqrt, log2, a fraction, or all."""
    if isinstance(share, str):
        return share
    return "all" if share is None or float(share) >= 1.0 else str(float(share))


def random_forest(
    n_estimators: int = 100,
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    max_features: str | float = 1.0,
    random_state: int = 42,
    max_bins: int = 32,
) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=n_estimators,
        maxDepth=MAX_DEPTH if max_depth is None else max_depth,
        minInstancesPerNode=min_samples_leaf,
        featureSubsetStrategy=_feature_share(max_features),
        seed=random_state,
        maxBins=max_bins,
    )


def gradient_boosting(
    n_estimators: int = 100,
    max_depth: int = 3,
    learning_rate: float = 0.1,
    subsample: float = 1.0,
    colsample_bytree: float = 1.0,
    min_child_weight: int = 1,
    gamma: float = 0.0,
    random_state: int = 42,
    max_bins: int = 32,
) -> GBTRegressor:
    """Boosted trees with squared loss; columns are sampled per node (MLlib), not per tree.

    min_child_weight is the least number of rows of a leaf, gamma the least gain of a split (mean per row).
    """
    return GBTRegressor(
        maxIter=n_estimators,
        maxDepth=max_depth,
        stepSize=learning_rate,
        subsamplingRate=subsample,
        featureSubsetStrategy=_feature_share(colsample_bytree),
        minInstancesPerNode=min_child_weight,
        minInfoGain=gamma,
        seed=random_state,
        maxBins=max_bins,
    )


def robust_linear(C: float = 1.0, epsilon: float = 1.35, max_iter: int = 100) -> LinearRegression:
    """Huber loss: large errors count linearly, as in support vector regression.

    C weighs the errors against the penalty (larger C, weaker penalty).
    """
    return LinearRegression(loss="huber", epsilon=epsilon, regParam=1e-3 / C, maxIter=max_iter)


class FourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Random cosine features whose products approximate the kernel exp(-gamma |x - y|^2)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="_features", outputCol="_fourier", gamma=0.1, size=128, seed=42):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, size=size, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size = self.getOrDefault(self.gamma), self.getOrDefault(self.size)
        seed = self.getSeed()

        @F.pandas_udf("array<double>")
        def cosines(vectors: pd.Series) -> pd.Series:
            x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))
            rng = np.random.default_rng(seed)
            weights = rng.normal(0.0, math.sqrt(2 * gamma), (x.shape[1], size))
            shift = rng.uniform(0.0, 2 * math.pi, size)
            return pd.Series(list(np.cos(x @ weights + shift) * math.sqrt(2.0 / size)))

        mapped = cosines(vector_to_array(self.getInputCol()))
        return df.withColumn(self.getOutputCol(), array_to_vector(mapped))
