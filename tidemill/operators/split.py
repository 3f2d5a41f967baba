"""Splits in time, and expanding cross-validation folds. Each adds a column; no rows move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.timecols import minus_years
from tidemill.operators.ranks import Positions, at_or_after

SPLIT = "split"


def split_years(df: DataFrame, time: str, years: int = 1) -> DataFrame:
    """`split` = test from (last time - years) on, else train."""
    cutoff = df.agg(minus_years(F.max(time), years).alias("cutoff")).scalar()
    return df.withColumn(SPLIT, F.when(F.col(time) >= cutoff, "test").otherwise("train"))


def split_three_way(df: DataFrame, time: str, test_years: int = 1, val_years: int = 1) -> DataFrame:
    """train / val / test: val is the last `val_years` of what is not test."""
    test_from = df.agg(minus_years(F.max(time), test_years).alias("cutoff")).scalar()
    older = df.where(F.col(time) < test_from)
    val_from = older.agg(minus_years(F.max(time), val_years).alias("cutoff")).scalar()
    label = F.when(F.col(time) >= test_from, "test").when(F.col(time) >= val_from, "val").otherwise("train")
    return df.withColumn(SPLIT, label)


def split_tail(df: DataFrame, time: str, tie: Sequence[str], n_tail: int, label: str = "test") -> DataFrame:
    """The last `n_tail` rows of the whole table in (time, *tie) order get `label`, others train.

    Rows without a time stand first, so they train.
    """
    if n_tail <= 0:
        return df.withColumn(SPLIT, F.lit("train"))
    return _tail(df, time, tie, n_tail, Positions(df, time, tie), label)


def _tail(df: DataFrame, time: str, tie: Sequence[str], n_tail: int, at: Positions, label: str = "test") -> DataFrame:
    if n_tail <= 0:
        return df.withColumn(SPLIT, F.lit("train"))
    if n_tail >= at.n:
        return df.withColumn(SPLIT, F.lit(label))
    first = at.rows_at([at.n - n_tail])[at.n - n_tail]
    return df.withColumn(SPLIT, F.when(at_or_after(first, time, tie), label).otherwise("train"))


def split_ratio(df: DataFrame, time: str, tie: Sequence[str], ratio: float = 0.1) -> DataFrame:
    """The last int(ratio * n) rows are test."""
    at = Positions(df, time, tie)
    return _tail(df, time, tie, int(ratio * at.n), at)


def expanding_folds(df: DataFrame, time: str, tie: Sequence[str], n_splits: int = 5, name: str = "block") -> DataFrame:
    """`block` 0..n_splits: fold i tests on block i and trains on all lower blocks.

    Blocks 1..n have floor(rows / (n + 1)) rows; block 0 takes the remainder.
    """
    at = Positions(df, time, tie)
    n = at.n
    size = n // (n_splits + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {n_splits} folds")
    starts = [n - (n_splits - i) * size for i in range(n_splits)]
    rows = at.rows_at(starts)
    block = F.lit(0)
    for rank in starts:
        block = block + at_or_after(rows[rank], time, tie).cast("int")
    return df.withColumn(name, block)


def fold_train(i: int, name: str = "block") -> Column:
    return F.col(name) < i


def fold_test(i: int, name: str = "block") -> Column:
    return F.col(name) == i


def split_report(df: DataFrame, time: str, by: str = SPLIT) -> DataFrame:
    """Rows, first and last time per split."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )
