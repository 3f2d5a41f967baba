"""Time slices, masks, and first/last rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.functions.timecols import DAY, seconds_interval
from tidemill.operators.buckets import join_same, with_ordinal

# Up to this many rows per series Spark trims each map task's rows before the shuffle.
_GROUP_LIMIT = 1_000


def first_days(df: DataFrame, time: str, days: int = 7) -> DataFrame:
    """Rows of the first `days` days, half-open.

    The first time is looked up at once, so the bounds are literals and reach the scan.
    """
    start, stop = df.agg(F.min(time), F.min(time) + seconds_interval(F.lit(days * DAY))).first()
    if start is None:
        return df.where(F.lit(False))
    start, stop = (F.lit(t).cast(df.schema[time].dataType) for t in (start, stop))
    return df.where((F.col(time) >= start) & (F.col(time) < stop))


def closed_range(df: DataFrame, time: str, start: Column, end: Column) -> DataFrame:
    return df.where(F.col(time).between(start, end))


def day_range(df: DataFrame, time: str, first_day: Column, last_day: Column) -> DataFrame:
    """From the start of `first_day` to the end of `last_day`, both included.

    Compared as timestamps, so the bounds reach the Parquet scan.
    """
    start = F.to_date(first_day).cast("timestamp_ntz")
    end = F.date_add(F.to_date(last_day), 1).cast("timestamp_ntz")
    return df.where((F.col(time) >= start) & (F.col(time) < end))


def split_by_mask(df: DataFrame, mask: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where the mask holds, all other rows); a null mask counts as not holding."""
    held = F.coalesce(mask, F.lit(False))
    return df.where(held), df.where(~held)


def skip_first(df: DataFrame, keys: Sequence[str], time: str, n: int) -> DataFrame:
    """Drop the rows of the first `n` times of each series; rows without a time stay.

    Only the n-th time of each series is looked up; the rows themselves are not sorted.
    """
    times = df.select(*keys, time).where(F.col(time).isNotNull()).distinct()
    rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time))
    head = times.withColumn("_rank", rank).where(F.col("_rank") <= n)
    if not keys:
        return df.where(F.coalesce(F.col(time) > head.agg(F.max(time)).scalar(), F.lit(True)))
    bound = head.groupBy(*keys).agg(F.max(time).alias("_bound"))
    return join_same(df, bound, keys, "left").where(F.coalesce(F.col(time) > F.col("_bound"), F.lit(True))).drop("_bound")


def last_rows(df: DataFrame, keys: Sequence[str], time: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The last `n` rows of each series; rows without a time are its first, a NULL key is a series."""
    if n <= _GROUP_LIMIT:
        newest = [F.col(c).desc() for c in (time, *tie)]
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    numbered = with_ordinal(df, keys, time, tie, name="_ordinal")
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    kept = join_same(numbered, size, keys).where(F.col("_ordinal") >= F.col("_size") - n)
    return kept.drop("_ordinal", "_size")
