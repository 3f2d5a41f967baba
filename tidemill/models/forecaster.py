"""One contract for all regressors: fit, predict, evaluate, save, load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.operators.metrics import point_metrics
from tidemill.operators.scale import Scaler, fit_scaler

PREDICTION = "prediction"
_LABEL, _FEATURES = "_label", "_features"
_META = "features array<string>, target string, target_kind string, center double, scale double"


class Forecaster:
    """An MLlib regressor over named feature columns.

    target_kind: None, standard, minmax, divide or log1p. The target is scaled before the fit and
    predictions are brought back, so `predict` always returns the target's own unit.
    """

    def __init__(
        self,
        estimator: Estimator | None,
        features: Sequence[str],
        target: str,
        target_kind: str | None = None,
        factor: float = 60_000.0,
        expand: Sequence[Estimator] = (),
    ):
        self.estimator = estimator
        self.features = list(features)
        self.target = target
        self.target_kind = target_kind
        self.factor = factor
        self.expand = list(expand)
        self.scaler = Scaler({})
        self.model: PipelineModel | None = None

    def _with_label(self, df: DataFrame) -> DataFrame:
        if self.target_kind == "log1p":
            return df.withColumn(_LABEL, F.log1p(self.target))
        if self.scaler.params:
            return self.scaler.transform(df, {self.target: _LABEL})
        return df.withColumn(_LABEL, F.col(self.target).cast("double"))

    @property
    def _vector(self) -> str:
        return self.expand[-1].getOutputCol() if self.expand else _FEATURES

    def _assembler(self) -> VectorAssembler:
        return VectorAssembler(inputCols=self.features, outputCol=_FEATURES)

    @property
    def stages_learn(self) -> bool:
        """Whether a stage before the regressor takes something from the rows."""
        return any(isinstance(s, Estimator) for s in self.expand)

    def stage_settings(self) -> tuple:
        """What the vectors depend on: models of equal settings read the same ones."""
        expand = [(type(s).__name__, *sorted((p.name, str(v)) for p, v in s.extractParamMap().items())) for s in self.expand]
        return (tuple(self.features), *expand)

    def assembled(self, df: DataFrame) -> DataFrame:
        """The rows with the vector that the regressor reads, for `fit` and `predict` with `assembled=True`."""
        out = self._assembler().transform(df)
        for stage in self.expand:
            out = stage.transform(out)
        return out.drop(*[c for c in (_FEATURES, *(s.getOutputCol() for s in self.expand)) if c != self._vector])

    def fit(self, df: DataFrame, assembled: bool = False) -> Forecaster:
        """`assembled`: the rows come from `assembled`, so only the regressor is left to fit."""
        if self.target_kind not in (None, "log1p"):
            self.scaler = fit_scaler(df, [self.target], self.target_kind, factor=self.factor)
        estimator = self.estimator.copy()
        estimator.setFeaturesCol(self._vector).setLabelCol(_LABEL).setPredictionCol(PREDICTION)
        if assembled:
            fitted = estimator.fit(self._with_label(df.select(self._vector, self.target)))
            self.model = PipelineModel([self._assembler(), *self.expand, fitted])
            return self
        rows = self._with_label(df.select(*self.features, self.target))
        self.model = Pipeline(stages=[self._assembler(), *self.expand, estimator]).fit(rows)
        return self

    @property
    def regressor(self):
        return self.model.stages[-1]

    def vectors(self, df: DataFrame) -> DataFrame:
        """Rows as the regressor sees them: feature vector and (scaled) label."""
        out = self._with_label(df)
        for stage in self.model.stages[:-1]:
            out = stage.transform(out)
        return out

    def predict(self, df: DataFrame, assembled: bool = False) -> DataFrame:
        stages = self.model.stages[-1] if assembled else self.model
        out = stages.transform(df).drop(*[s.getOutputCol() for s in self.model.stages[:-1]])
        if self.target_kind == "log1p":
            return out.withColumn(PREDICTION, F.expm1(PREDICTION))
        if self.scaler.params:
            return self.scaler.inverse(out, {PREDICTION: self.target})
        return out

    def evaluate(self, df: DataFrame, scores=("rmse", "mae", "mape", "sd")) -> DataFrame:
        return point_metrics(self.predict(df), self.target, PREDICTION, scores=scores)

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        center, scale = self.scaler.params.get(self.target, (0.0, 1.0))
        row = (self.features, self.target, self.target_kind, center, scale)
        spark.createDataFrame([row], _META).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forecaster:
        meta = spark.read.schema(_META).json(f"{path}/meta").first()
        out = cls(None, meta["features"], meta["target"], meta["target_kind"])
        out.model = PipelineModel.load(f"{path}/model")
        if meta["target_kind"] not in (None, "log1p"):
            out.scaler = Scaler({meta["target"]: (meta["center"], meta["scale"])})
        return out
