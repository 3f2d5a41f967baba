"""Regular grids and resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.timecols import epoch_seconds, floor_time, seconds_interval
from tidemill.operators.buckets import series_of, with_series
from tidemill.operators.pieces import gridded_neighbours

_POINTS_PER_BLOCK = 4_096


def regular_grid(df: DataFrame, keys: Sequence[str], time: str, step: int) -> DataFrame:
    """Every `step` seconds from the first to the last time of each series.

    Expanded in two levels, so that neither one array nor one task holds a whole long series.
    """
    span = df.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    steps = F.floor((epoch_seconds("_hi") - epoch_seconds("_lo")) / step)
    # A fixed number of partitions (the cluster's cores): block rows are tiny before they expand,
    # so adaptive execution would merge them all into one task.
    tasks = df.sparkSession.sparkContext.defaultParallelism
    blocks = (
        span.where(F.col("_lo").isNotNull())
        .withColumn("_steps", steps)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_steps") / _POINTS_PER_BLOCK))))
        .repartition(tasks, *keys, "_block")
    )
    start = F.col("_block") * _POINTS_PER_BLOCK
    stop = F.least(start + _POINTS_PER_BLOCK - 1, F.col("_steps"))
    points = blocks.withColumn("_i", F.explode(F.sequence(start, stop)))
    return points.select(*keys, (F.col("_lo") + seconds_interval(F.col("_i") * step)).alias(time))


def reindex(df: DataFrame, keys: Sequence[str], time: str, step: int, aligned: bool = False) -> DataFrame:
    """The rows of `df` (one per series and time) put on the regular grid; gaps become null rows.

    Rows between the steps are left out. `aligned`: there are none, so rows emit the steps that are missing
    behind them, without a join (`pieces.gridded_neighbours`, which stores the rows when called).
    """
    rest = [c for c in df.columns if c not in (*keys, time)]
    if aligned:
        return gridded_neighbours(df, keys, time, [], step).select(*keys, time, *rest)
    grid = with_series(regular_grid(df, keys, time, step), keys)
    return _matched(grid, df, keys, time).select(*keys, time, *rest)


def _matched(grid: DataFrame, df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Grid rows with the columns of `df` at the same series and time; a NULL key is a series too."""
    return grid.join(with_series(df, keys).drop(*keys), [*series_of(keys), time], "left").drop(*series_of(keys))


def resample_mean(
    df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], step: int, empty_bins: bool = True
) -> DataFrame:
    """Mean per step; empty steps inside a series' span appear as null rows."""
    binned = df.withColumn(time, floor_time(time, step)).groupBy(*keys, time)
    means = binned.agg(*[F.avg(c).alias(c) for c in cols])
    return reindex(means, keys, time, step, aligned=True) if empty_bins else means


def resample_month_mean(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str]) -> DataFrame:
    """Mean per calendar month, labelled with the month's last day; empty months are null rows."""
    labelled = df.withColumn(time, F.last_day(F.to_date(time)))
    means = labelled.groupBy(*keys, time).agg(*[F.avg(c).alias(c) for c in cols])
    span = means.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    months = F.sequence(F.trunc("_lo", "month"), F.trunc("_hi", "month"), F.expr("interval 1 month"))
    grid = span.select(*keys, F.explode(months).alias("_month")).select(*keys, F.last_day("_month").alias(time))
    return _matched(with_series(grid, keys), means, keys, time).withColumn(time, F.col(time).cast("timestamp_ntz"))


def resample_sum(df: DataFrame, keys: Sequence[str], time: str, sums: Mapping[str, str], step: int) -> DataFrame:
    """Sum per step (`sums`: output name -> column); only steps that hold rows."""
    binned = df.withColumn(time, floor_time(time, step)).groupBy(*keys, time)
    return binned.agg(*[F.sum(c).alias(name) for name, c in sums.items()])
