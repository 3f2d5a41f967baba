"""Standard and min-max scaling with saved parameters.

Spark ML's StandardScaler divides by the sample deviation and its MinMaxScaler maps constant
columns to the middle of the range; forecasts here need the population deviation and 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

_SCHEMA = "column string, center double, scale double"


@dataclass(frozen=True)
class Scaler:
    """`(x - center) / scale` per column; two numbers per column live on the driver."""

    params: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
        rename = rename or {}
        return df.withColumns(
            {rename.get(c, c): (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.params.items()}
        )

    def inverse(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """`columns`: column to bring back -> scaled column whose parameters apply."""
        return df.withColumns(
            {c: F.col(c) * F.lit(self.params[p][1]) + F.lit(self.params[p][0]) for c, p in columns.items()}
        )

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, m, s) for c, (m, s) in self.params.items()], _SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        rows = spark.read.schema(_SCHEMA).parquet(path).collect()
        return cls({r["column"]: (r["center"], r["scale"]) for r in rows})


def fit_scaler(
    df: DataFrame,
    cols: Sequence[str],
    kind: str | None = "standard",
    skip: Sequence[str] = (),
    factor: float = 60_000.0,
) -> Scaler:
    """Fit on the rows of `df` (pass only the rows to learn from) with one aggregation.

    kind: standard, minmax, divide (by `factor`); anything else scales nothing. A constant column
    is only centred.
    """
    used = [c for c in cols if c not in skip]
    if kind == "divide":
        return Scaler({c: (0.0, float(factor)) for c in used})
    if kind == "standard":
        parts = [(F.avg(c), F.stddev_pop(c)) for c in used]
    elif kind == "minmax":
        parts = [(F.min(c), F.max(c) - F.min(c)) for c in used]
    else:
        return Scaler({})
    if not used:
        return Scaler({})
    row = df.agg(*[part.cast("double").alias(f"p{i}") for i, part in enumerate(p for pair in parts for p in pair)]).first()
    return Scaler({c: (row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(used)})
