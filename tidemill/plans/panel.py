"""Many metered series joined with weather: one plan for the whole panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import NumericType

from tidemill.functions.calendar import with_calendar
from tidemill.functions.timecols import HOUR
from tidemill.operators.clean import dedup_keep_first
from tidemill.operators.features import lag_and_rolling
from tidemill.operators.fill import fill_midpoint, fill_neighbour_mean, interpolate_time
from tidemill.operators.filters import skip_first
from tidemill.operators.grid import resample_mean
from tidemill.operators.joins import left_join_time
from tidemill.sources.tables import kept


def clean_panel(
    power: DataFrame,
    weather: DataFrame,
    key: str,
    part: str,
    time: str,
    value: str,
    power_order: Sequence[str | Column],
    weather_order: Sequence[str | Column],
    step: int = HOUR,
    skip: int = 5,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Per (series, part): keep-first, mean per step, midpoint fill. Then per series: weather by
    time, first `skip` times dropped, remaining gaps filled along time in both directions.

    `part` is the source file of a row (a year); gaps between parts are not filled by the first step. Both
    tables are read once, when this is called: means and joined rows are stored.
    """
    unique = dedup_keep_first(power, [key, part, time], power_order)
    means = resample_mean(unique, [key, part], time, [value], step, empty_bins=False)
    whole = fill_midpoint(means, [key, part], time, [value], step, grid=True).drop(part)
    merged = kept(left_join_time(whole, weather, time, weather_order).drop(*drop), "panel")
    merged = skip_first(merged, [key], time, skip)
    numeric = [f.name for f in merged.schema.fields if f.name not in (key, time) and isinstance(f.dataType, NumericType)]
    return interpolate_time(merged, [key], time, numeric, step, both_edges=True)


def panel_features(
    df: DataFrame, key: str, time: str, target: str, keep: Sequence[str] = (), lags: Sequence[int] = (1, 24, 168), step: int = HOUR
) -> DataFrame:
    """Calendar and lags per series; rows with a null are dropped."""
    base = with_calendar(df.select(key, time, target, *keep), time)
    return lag_and_rolling(base, [key], time, target, lags, (), step).dropna("any")


def weather_lags(df: DataFrame, time: str, col: str, order: Sequence[str | Column], lags: Sequence[int] = (1, 24, 48, 72, 168)) -> DataFrame:
    """Keep-first weather rows with row lags (rows, not hours: no grid is laid first)."""
    unique = dedup_keep_first(df, [time], order)
    return lag_and_rolling(unique, [], time, col, lags).dropna("any")


def clean_weather(
    df: DataFrame, time: str, fill: Sequence[str], col: str, order: Sequence[str], lags: Sequence[int] = (1, 24, 48, 72, 168)
) -> DataFrame:
    """Weather rows in source order: single gaps of `fill` take the mean of the rows around them (repeated
    times still present), then keep-first, then row lags of `col`; rows with a null are dropped.
    """
    filled = fill_neighbour_mean(df, [], time, fill, tie=order)
    return weather_lags(filled, time, col, order, lags)
