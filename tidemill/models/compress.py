"""Feature compression by principal components, with reconstruction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemill.operators.scale import Scaler, fit_scaler


class Compressor:
    """Standard scaling (which centres; MLlib's PCA does not), then `k` components."""

    def __init__(self, features: Sequence[str], k: int = 8):
        self.features, self.k = list(features), k
        self.scaler: Scaler | None = None
        self.model = None

    def _vectors(self, df: DataFrame) -> DataFrame:
        scaled = self.scaler.transform(df, {c: f"_z_{c}" for c in self.features})
        names = [f"_z_{c}" for c in self.features]
        return VectorAssembler(inputCols=names, outputCol="_z").transform(scaled).drop(*names)

    def fit(self, df: DataFrame) -> Compressor:
        self.scaler = fit_scaler(df, self.features)
        self.model = PCA(k=self.k, inputCol="_z", outputCol="_codes").fit(self._vectors(df))
        return self

    def encode(self, df: DataFrame, prefix: str = "code_") -> DataFrame:
        """One column per component, usable as model features."""
        out = self.model.transform(self._vectors(df)).withColumn("_codes", vector_to_array("_codes"))
        codes = {f"{prefix}{i}": F.col("_codes")[i] for i in range(self.k)}
        return out.withColumns(codes).drop("_codes", "_z")

    def reconstruct(self, df: DataFrame) -> DataFrame:
        """Adds `original` and `rebuilt`, both scaled arrays."""
        basis = self.model.pc.toArray()

        @F.pandas_udf("array<double>")
        def rebuild(codes: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(codes.to_numpy()) @ basis.T)) if len(codes) else codes

        out = self.model.transform(self._vectors(df))
        return out.withColumns(
            {"original": vector_to_array("_z"), "rebuilt": rebuild(vector_to_array("_codes"))}
        ).drop("_z", "_codes")
