"""Lag, rolling and sequence features."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.operators.buckets import over_rows


def lag_name(col: str, k: int) -> str:
    return f"{col}_lag_{k}"


def mean_name(col: str, w: int) -> str:
    return f"{col}_mean_{w}"


def past_mean(col: str, rows: int):
    """Mean of the `rows` rows before the current one; null unless all of them have a value."""

    def build(spec) -> Column:
        frame = spec.rowsBetween(-rows, -1)
        return F.when(F.count(col).over(frame) == rows, F.avg(col).over(frame))

    return build


def lag_and_rolling(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    col: str,
    lags: Sequence[int] = (),
    windows: Sequence[int] = (),
    step: int | None = None,
) -> DataFrame:
    """All lags and past means of one column in a single pass over the series."""
    columns = {lag_name(col, k): (lambda w, k=k: F.lag(col, k).over(w)) for k in lags}
    columns.update({mean_name(col, n): past_mean(col, n) for n in windows})
    return over_rows(df, keys, time, columns, back=max([*lags, *windows]), step=step)


def sequence_columns(features: Sequence[str], target: str) -> tuple[list[str], list[str]]:
    """(lag columns by rising lag, remaining columns)."""
    pattern = re.compile(rf"{re.escape(target)}_lag_(\d+)$")
    lags = sorted((int(m.group(1)), c) for c in features if (m := pattern.match(c)))
    ordered = [c for _, c in lags]
    return ordered, [c for c in features if c not in ordered]


def make_sequences(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """(keys, sequence array, static array, target): the inputs of a sequence model."""
    lags, static = sequence_columns(features, target)

    def pack(cols: Sequence[str]) -> Column:
        return F.array(*[F.col(c).cast("double") for c in cols])

    return df.select(*keys, pack(lags).alias("sequence"), pack(static).alias("static"), F.col(target))
