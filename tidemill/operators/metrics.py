"""Forecast scores as aggregations over (actual, predicted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_TINY = 1e-8


def _error(y: str, yhat: str) -> Column:
    return F.col(yhat) - F.col(y)


def rmse(y: str, yhat: str) -> Column:
    return F.sqrt(F.avg(_error(y, yhat) * _error(y, yhat)))


def mae(y: str, yhat: str) -> Column:
    return F.avg(F.abs(_error(y, yhat)))


def mape(y: str, yhat: str) -> Column:
    """Percent; rows with a zero actual are left out (see `n_zero_actual`)."""
    return F.avg(F.try_divide(F.abs(_error(y, yhat)), F.abs(F.col(y)))) * 100


def mape_shifted(y: str, yhat: str) -> Column:
    """Percent, with 1e-8 added to the actual in place of a guard."""
    return F.avg(F.abs(_error(y, yhat) / (F.col(y) + F.lit(_TINY)))) * 100


def smape(y: str, yhat: str) -> Column:
    size = F.abs(F.col(yhat)) + F.abs(F.col(y))
    return F.avg(2 * F.abs(_error(y, yhat)) / F.when(size == 0, F.lit(_TINY)).otherwise(size)) * 100


def error_sd(y: str, yhat: str) -> Column:
    return F.stddev_pop(_error(y, yhat))


def r2(y: str, yhat: str) -> Column:
    """1 - SSE/SST (not the squared correlation)."""
    both = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    sse = F.sum(_error(y, yhat) * _error(y, yhat))
    sst = F.count_if(both) * F.var_pop(F.when(both, F.col(y)))
    return 1 - F.try_divide(sse, sst)


def pinball_loss(y: str | Column, yhat: str | Column, q: float) -> Column:
    y, yhat = (F.col(c) if isinstance(c, str) else c for c in (y, yhat))
    return F.greatest(q * (y - yhat), (q - 1) * (y - yhat))


def pinball(y: str, yhat: str, q: float) -> Column:
    return F.avg(pinball_loss(y, yhat, q))


def coverage(y: str, lower: str, upper: str) -> Column:
    """Percent of rows inside the closed interval."""
    return F.avg(F.col(y).between(F.col(lower), F.col(upper)).cast("int")) * 100


def width(lower: str, upper: str) -> Column:
    return F.avg(F.col(upper) - F.col(lower))


SCORES = {"rmse": rmse, "mae": mae, "mape": mape, "sd": error_sd, "r2": r2, "smape": smape}


def point_metrics(
    df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), scores: Sequence[str] = ("rmse", "mae", "mape", "sd")
) -> DataFrame:
    """All requested scores in one pass, per group of `by`."""
    aggregates = [SCORES[s](y, yhat).alias(s) for s in scores]
    zeros = F.count_if(F.col(y) == 0).alias("n_zero_actual")
    return df.groupBy(*by).agg(*aggregates, zeros)


def interval_metrics(
    df: DataFrame, y: str, lower: str, median: str, upper: str, q=(0.01, 0.5, 0.99), by: Sequence[str] = ()
) -> DataFrame:
    """Coverage (picp), mean width (mpiw) and the three pinball losses."""
    return df.groupBy(*by).agg(
        coverage(y, lower, upper).alias("picp"),
        width(lower, upper).alias("mpiw"),
        pinball(y, lower, q[0]).alias("pinball_lower"),
        pinball(y, median, q[1]).alias("pinball_median"),
        pinball(y, upper, q[2]).alias("pinball_upper"),
    )


def fold_means(df: DataFrame, y: str, yhat: str, fold: str, by: Sequence[str] = (), scores=("rmse", "mae", "mape", "sd")) -> DataFrame:
    """Scores per fold, then their plain mean over folds."""
    per_fold = point_metrics(df, y, yhat, [*by, fold], scores)
    return per_fold.groupBy(*by).agg(*[F.avg(s).alias(f"cv_{s}") for s in scores])


def reconstruction_metrics(df: DataFrame, original: str, rebuilt: str) -> DataFrame:
    """Mean squared and absolute error over all cells of two array columns."""
    def cells(power: int) -> Column:
        gap = F.zip_with(original, rebuilt, lambda a, b: F.abs(a - b) if power == 1 else (a - b) * (a - b))
        return F.sum(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))
    n = F.sum(F.size(original))
    return df.agg((cells(2) / n).alias("recon_mse"), (cells(1) / n).alias("recon_mae"))
