"""Autocorrelation and partial autocorrelation of gridded series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemill.functions.timecols import epoch_seconds
from tidemill.operators.buckets import OWNED, PIECE, ROWS_PER_PIECE, group_sizes, join_per_group, with_halo
from tidemill.sources.tables import kept

Z_95 = 1.959963984540054


def autocorrelation(
    df: DataFrame, keys: Sequence[str], time: str, value: str, lags: int, step: int, z: float = Z_95
) -> DataFrame:
    """(keys, lag, acf, lower, upper, n) for lags 0..`lags`, with Bartlett's band.

    Each piece of a series also receives the `lags` rows after it and adds up its own lag
    products by a Fourier transform; pieces send one sum per lag, never pairs of rows. Rows without a time
    stand on no step and are left out; two rows of a series on one step are refused. The series is stored
    when this is called, which runs what it comes from once.
    """
    placed = df.where(F.col(time).isNotNull()).select(*keys, (epoch_seconds(time) / step).cast("long").alias("_pos"), F.col(value).alias("_v"))
    # Counts, means and rows read the series: what it comes from runs once.
    placed = kept(placed, "series")
    stats = placed.groupBy(*keys).agg(F.avg("_v").alias("_mean"), F.count("_v").alias("n"))
    n_series = group_sizes(placed.select(*keys), keys)[0] if keys else 1
    centred = join_per_group(placed, stats.select(*keys, "_mean"), keys, n_series)
    centred = centred.select(*keys, "_pos", F.coalesce(F.col("_v") - F.col("_mean"), F.lit(0.0)).alias("_x"))
    width = max(ROWS_PER_PIECE, 8 * lags)
    pieces = with_halo(centred, F.col("_pos"), width, back=0, ahead=lags)

    def lag_sums(frame: pd.DataFrame) -> pd.DataFrame:
        base = int(frame[PIECE].iloc[0]) * width
        place = frame["_pos"].to_numpy() - base
        dense = np.zeros(width + lags)
        near = place < width + lags
        if len(np.unique(place)) < len(place):
            raise ValueError("two rows of a series on one step: average them first")
        dense[place[near]] = frame["_x"].to_numpy()[near]
        # All lags at once, by the transform of the piece and of the piece with the rows behind it.
        size = 1 << (width + lags - 1).bit_length()
        product = np.fft.rfft(dense[:width], size).conj() * np.fft.rfft(dense, size)
        sums = np.fft.irfft(product, size)[: lags + 1]
        out = pd.DataFrame({"lag": np.arange(lags + 1), "_s": sums})
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out[[*keys, "lag", "_s"]]

    key_types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
    schema = ", ".join([*key_types, "lag int", "_s double"])
    partial = pieces.groupBy(*keys, PIECE).applyInPandas(lag_sums, schema)
    summed = partial.groupBy(*keys, "lag").agg(F.sum("_s").alias("_s"))
    by_lag = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("lag")
    total = F.first("_s").over(by_lag)
    acf = summed.withColumn("acf", F.try_divide("_s", total))
    acf = join_per_group(acf, stats.select(*keys, "n"), keys, n_series)
    earlier = by_lag.rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") ** 2)).over(earlier), F.lit(0.0))
    band = F.when(F.col("lag") == 0, 0.0).otherwise(z * F.sqrt((1 + 2 * squares) / F.col("n")))
    return acf.withColumn("_band", band).select(
        *keys, "lag", "acf", (F.col("acf") - F.col("_band")).alias("lower"), (F.col("acf") + F.col("_band")).alias("upper"), "n"
    )


def partial_autocorrelation(acf: DataFrame, keys: Sequence[str], z: float = Z_95) -> DataFrame:
    """Durbin-Levinson recursion on an autocorrelation table: (keys, lag, pacf, lower, upper).

    A group is one series' autocorrelations, so its size is the number of lags.
    """

    def recursion(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lag")
        r = frame["acf"].to_numpy()
        pacf, phi, error = [1.0], np.zeros(0), 1.0
        for k in range(1, len(r)):
            reflection = (r[k] - phi @ r[k - 1 : 0 : -1]) / error if error > 0 else np.nan
            phi = np.append(phi - reflection * phi[::-1], reflection)
            error *= 1 - reflection**2
            pacf.append(reflection)
        band = z / np.sqrt(frame["n"].to_numpy())
        band[0] = 0.0
        out = frame[[*keys, "lag"]].copy()
        out["pacf"], out["lower"], out["upper"] = pacf, pacf - band, pacf + band
        return out

    key_types = [f"`{f.name}` {f.dataType.simpleString()}" for f in acf.select(*keys).schema.fields]
    schema = ", ".join([*key_types, "lag int", "pacf double", "lower double", "upper double"])
    group = list(keys) or ["_series"]
    return acf.withColumns({} if keys else {"_series": F.lit(0)}).groupBy(*group).applyInPandas(recursion, schema)
