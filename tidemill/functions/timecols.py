"""Timestamp arithmetic on TIMESTAMP_NTZ columns.

Built from date and clock fields, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86_400
HOUR = 3_600
HALF_HOUR = 1_800
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 (rounded down) of a timestamp column."""
    c = f"`{ts}`"
    return F.expr(
        f"unix_date(CAST({c} AS DATE)) * {DAY}L + hour({c}) * {HOUR} + minute({c}) * 60 + second({c})"
    )


def micros(ts: str) -> str:
    """SQL text for the microseconds since 1970 of a timestamp expression."""
    return (
        f"(unix_date(CAST({ts} AS DATE)) * {DAY}000000L + hour({ts}) * {HOUR}000000L + minute({ts}) * 60000000L "
        f"+ CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT))"
    )


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.expr(micros(f"`{ts}`"))


def from_seconds(seconds: str | Column) -> Column:
    """Seconds since 1970 -> TIMESTAMP_NTZ."""
    return F.expr(_EPOCH) + seconds_interval(seconds)


def seconds_interval(seconds: str | Column) -> Column:
    seconds = _col(seconds)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def floor_time(ts: str, step_seconds: int) -> Column:
    """Start of the step that holds `ts`, steps counted from 1970-01-01 00:00."""
    return from_seconds(F.floor(epoch_seconds(ts) / step_seconds) * step_seconds)


def slot_timestamp(date: str | Column, slot: str | Column, slot_minutes: int = 30) -> Column:
    """Date plus a 1-based slot number; slots past the end of the day run into the next one."""
    start = _col(date).cast("timestamp_ntz")
    return start + F.make_dt_interval(
        F.lit(0), F.lit(0), ((_col(slot) - 1) * slot_minutes).cast("int")
    )


def parse_day(text: str | Column, pattern: str = "d-MMM-yyyy") -> Column:
    """Day text such as 7-Jan-2016 -> TIMESTAMP_NTZ, NULL when it does not parse."""
    return F.try_to_date(_col(text), pattern).cast("timestamp_ntz")


def minus_years(ts: str | Column, years: int) -> Column:
    """Calendar-aware: 29 February goes to the 28th and the time of day is kept."""
    return _col(ts) - F.make_ym_interval(F.lit(years), F.lit(0))
