"""Seasonal profiles, distributions and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.operators.buckets import group_sizes, join_per_group
from tidemill.operators.gram import wide_correlations
from tidemill.operators.quantiles import exact_quantiles


def mean_profile(df: DataFrame, by: dict[str, Column], value: str, name: str = "mean") -> DataFrame:
    """Mean of `value` per combination of the `by` expressions."""
    return df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.avg(value).alias(name))


def pivot_profile(
    df: DataFrame, row: dict[str, Column], wide: Column, levels: Sequence, value: str, prefix: str = ""
) -> DataFrame:
    """Mean of `value` with one column per level of `wide`.

    Levels are given, which saves the extra pass Spark would need to find them.
    """
    keyed = df.select(*[c.alias(n) for n, c in row.items()], wide.alias("_wide"), F.col(value).alias("_v"))
    table = keyed.groupBy(*row).pivot("_wide", list(levels)).agg(F.avg("_v"))
    return table.withColumnsRenamed({str(level): f"{prefix}{level}" for level in levels})


def iqr_bounds(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """(keys, q1, q3, lower, upper) with fences `reach` interquartile ranges outside."""
    quartiles = exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return quartiles.withColumns({"lower": F.col("q1") - reach * iqr, "upper": F.col("q3") + reach * iqr})


def iqr_outliers(df: DataFrame, value: str, reach: float = 1.5) -> DataFrame:
    """Rows outside the fences, with the fences attached."""
    bounds = iqr_bounds(df, [], value, reach).first()
    lower, upper = F.lit(bounds["lower"]), F.lit(bounds["upper"])
    outside = df.where((F.col(value) < lower) | (F.col(value) > upper))
    return outside.withColumns({"lower": lower, "upper": upper})


def boxplot_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last value inside the fences) and number of points outside, per group."""
    seen = df.select(*keys, value).where(F.col(value).isNotNull())
    n_groups, largest = group_sizes(seen, keys)
    quartiles = exact_quantiles(seen, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, most_rows=largest)
    iqr = F.col("q3") - F.col("q1")
    fenced = quartiles.withColumns({"_lo": F.col("q1") - reach * iqr, "_hi": F.col("q3") + reach * iqr})
    rows = join_per_group(seen, fenced, keys, n_groups)
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    return rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n_rows"),
    )


#: Columns from which a table counts as wide.
WIDE = 24


def _corr(a: Column, b: Column) -> Column:
    """Over the rows where both have a value; NULL without spread, where `corr` divides by zero."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr) for every ordered pair, from one pass over the table.

    Few columns are one aggregation; its expressions grow with the square of their number, so wide tables go
    through matrix products (`gram.wide_correlations`).
    """
    if len(cols) > WIDE:
        return wide_correlations(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one_row = df.agg(*[_corr(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("col_a"), F.lit(right).alias("col_b"), F.col(f"c{i}").alias("corr")))
    return one_row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null), most nulls first."""
    cols = list(cols or df.columns)
    one_row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols]
    long = one_row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return long.orderBy(F.col("n_null").desc(), "column")


def value_bounds(df: DataFrame, cols: Sequence[str], margin: float = 2.0) -> DataFrame:
    """Common lower and upper bound of several columns, widened by `margin`."""
    low, high = [F.min(c) for c in cols], [F.max(c) for c in cols]
    least = F.least(*low) if len(cols) > 1 else low[0]
    most = F.greatest(*high) if len(cols) > 1 else high[0]
    return df.agg((least - margin).alias("y_min"), (most + margin).alias("y_max"))
