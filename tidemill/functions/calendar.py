"""Calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Month numbers of each season.
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Autumn": (9, 10, 11),
}
SEASONS = list(SEASON_MONTHS)


def weekday(ts: str) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(F.col(ts))


def is_weekend(ts: str) -> Column:
    return (weekday(ts) >= 5).cast("int")


def week_type(ts: str) -> Column:
    return F.when(weekday(ts) >= 5, "Weekend").otherwise("Weekday")


def minute_of_day(ts: str) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def season(ts: str) -> Column:
    month = F.month(ts)
    label = F.lit(None).cast("string")
    for name, months in SEASON_MONTHS.items():
        label = F.when(month.isin(*months), name).otherwise(label)
    return label


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(
        {"hour": F.hour(ts), "weekday": weekday(ts), "month": F.month(ts), "is_weekend": is_weekend(ts)}
    )


def with_cycles(df: DataFrame, hour="hour", weekday_col="weekday", month="month") -> DataFrame:
    """Sine and cosine of hour, weekday and month; hour and month rounded to 14 digits."""

    def angle(value: Column, period: int) -> Column:
        return value * F.lit(2 * math.pi) / period

    h, w, m = angle(F.col(hour), 24), angle(F.col(weekday_col), 7), angle(F.col(month) - 1, 12)
    return df.withColumns(
        {
            "hour_sin": F.round(F.sin(h), 14),
            "hour_cos": F.round(F.cos(h), 14),
            "weekday_sin": F.sin(w),
            "weekday_cos": F.cos(w),
            "month_sin": F.round(F.sin(m), 14),
            "month_cos": F.round(F.cos(m), 14),
        }
    )
