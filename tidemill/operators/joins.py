"""Joins on time and alignment of predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.operators.clean import dedup_keep_first


def left_join_time(
    left: DataFrame, right: DataFrame, time: str, right_order: Sequence[str | Column] | None = None
) -> DataFrame:
    """Left equi-join on time, right side reduced to one row per time first.

    No broadcast hint: Spark broadcasts the right side itself when its measured size allows, and
    splits skewed times otherwise.
    """
    if right_order is not None:
        right = dedup_keep_first(right, [time], right_order)
    return left.join(right, time, "left")


def align(truth: DataFrame, predictions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions put next to their rows by key (never by position)."""
    return truth.join(predictions, list(on), "inner")


def stack_predictions(df: DataFrame, keys: Sequence[str], y: str, models: Mapping[str, str]) -> DataFrame:
    """Wide -> long: one row per (row, model). `models`: model name -> prediction column."""
    pairs = [F.struct(F.lit(m).alias("model"), F.col(c).alias("y_pred")) for m, c in models.items()]
    exploded = df.withColumn("_pair", F.explode(F.array(*pairs)))
    return exploded.select(*keys, F.col(y).alias("y_true"), "_pair.model", "_pair.y_pred")


def models_side_by_side(long: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Long -> wide: one column per model."""
    return long.groupBy(*keys, "y_true").pivot("model", list(models)).agg(F.first("y_pred"))
