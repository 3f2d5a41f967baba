"""One national series of settlement slots: cleaning and features, as single lazy plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from tidemill.functions.calendar import with_calendar, with_cycles
from tidemill.functions.numeric import round_half_even, row_sum, safe_ratio
from tidemill.functions.timecols import HALF_HOUR, parse_day, slot_timestamp
from tidemill.operators.clean import dedup_keep_first, union_by_name
from tidemill.operators.features import lag_and_rolling
from tidemill.operators.fill import interpolate_time
from tidemill.operators.grid import reindex

# Lags and window lengths in half-hours (hours back to one week).
LAGS = (1, 2, 48, 96, 336)
WINDOWS = (48, 336)


def stack_sources(sources: Sequence[DataFrame], date: str, slot: str, time: str = "datetime") -> DataFrame:
    """Sources one under another, with their position and the timestamp of each slot."""
    numbered = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    stacked = union_by_name(numbered).withColumn(date, parse_day(date))
    return stacked.withColumn(time, slot_timestamp(date, slot))


def clean_slots(
    sources: Sequence[DataFrame], date: str, slot: str, drop: Sequence[str] = (), time: str = "datetime", step: int = HALF_HOUR
) -> DataFrame:
    """Union, timestamps, keep-first, regular grid, null flag, fill, round to whole numbers.

    "First" is source order: a clock-change day of 50 slots runs into the next midnight, and its
    last two slots win over that day's own first two. The sources are read once, when this is called: the
    rows that stay are stored, and grid and fill run on them in one pass.
    """
    stacked = stack_sources(sources, date, slot, time).drop(*drop)
    unique = dedup_keep_first(stacked, [time], ["_source", date, slot]).drop("_source", date)
    numeric = [f.name for f in unique.schema.fields if isinstance(f.dataType, NumericType)]
    # Slots are half hours apart; a wider step leaves some of them out.
    rows = unique if HALF_HOUR % step == 0 else reindex(unique, [], time, step)
    filled = interpolate_time(rows, [], time, numeric, step, flag="is_interpolated", grid=True)
    return filled.withColumns({c: round_half_even(c) for c in numeric})


def build_features(
    df: DataFrame,
    time: str,
    target: str,
    flows: Sequence[str],
    ratios: Mapping[str, tuple[str, str]],
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    step: int = HALF_HOUR,
) -> DataFrame:
    """Calendar, lags, past means, net flow and capacity factors; rows with a null are dropped."""
    out = lag_and_rolling(with_calendar(df, time), [], time, target, lags, windows, step)
    out = out.withColumn("net_import", row_sum(flows))
    out = out.withColumns({name: safe_ratio(num, den) for name, (num, den) in ratios.items()})
    return out.dropna("any")


def encode_features(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Calendar numbers become points on a circle; superseded columns go."""
    return with_cycles(df).drop("hour", "weekday", "month", *drop)
