"""Scalar expressions and row-wise helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def row_sum(cols: Sequence[str]) -> Column:
    """Sum of the non-null cells of a row; 0 when all are null."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])


def safe_ratio(num: str, den: str) -> Column:
    """Quotient, NULL for a zero or missing denominator."""
    return F.try_divide(F.col(num), F.col(den))


def any_null(cols: Sequence[str]) -> Column:
    """1 when any of the cells is null, else 0."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]).cast("int")


def round_half_even(col: str | Column, digits: int = 0) -> Column:
    return F.bround(col, digits)


def clip(col: str | Column, lower: Column, upper: Column) -> Column:
    """Bounded value; NULL stays NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col < lower, lower).when(col > upper, upper).otherwise(col)


def levels_of(df: DataFrame, col: str, limit: int = 1000) -> list:
    """Distinct non-null values of a category column, sorted; refuses more than `limit`."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} levels; it is not a category column")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, col: str, levels: Sequence | None = None, prefix: str | None = None) -> DataFrame:
    """One 0/1 column per level (all levels kept); a missing value gives 0 everywhere."""
    levels = levels_of(df, col) if levels is None else levels
    prefix = col if prefix is None else prefix
    flags = {
        f"{prefix}_{level}": F.coalesce(F.col(col) == F.lit(level), F.lit(False)).cast("int")
        for level in levels
    }
    return df.withColumns(flags).drop(col)


def with_errors(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Signed, absolute and relative forecast error columns."""
    return df.withColumns(
        {
            "error": F.col(yhat) - F.col(y),
            "abs_error": F.abs(F.col(yhat) - F.col(y)),
            "rel_error": F.try_divide(F.abs(F.col(yhat) - F.col(y)), F.abs(F.col(y))),
        }
    )
