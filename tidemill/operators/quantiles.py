"""Exact, linearly interpolated quantiles per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.operators.buckets import group_sizes, join_per_group

# Spark's `percentile` keeps every distinct value of a group in one task's memory, so it is used
# only for groups of at most this many rows.
DIRECT_ROWS = 1_000_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    direct_rows: int = DIRECT_ROWS,
    most_rows: int | None = None,
) -> DataFrame:
    """One row per group with one column per entry of `probs` (name -> probability).

    `most_rows`: rows of the largest group, or any number known to be no smaller; counted when
    not given.
    """
    seen = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if most_rows is None or most_rows > direct_rows:
        n_groups, largest = group_sizes(seen, keys)
    else:
        n_groups, largest = 0, most_rows
    if largest <= direct_rows:
        picked = seen.groupBy(*keys).agg(F.percentile("_v", list(probs.values())).alias("_q"))
        return picked.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    return _bracketed(seen, keys, probs, n_groups, largest, direct_rows)


def _bracketed(
    seen: DataFrame, keys: Sequence[str], probs: Mapping[str, float], n_groups: int, largest: int, direct_rows: int
) -> DataFrame:
    """For large groups: a sketch brackets each quantile, one more pass ranks only the bracket.

    Rows below a bracket are counted, equal values are merged before the shuffle, so a task
    receives only the distinct values of one bracket (about 6 n / accuracy).
    """
    accuracy = max(10_000, min(1_000_000, 6 * largest // max(direct_rows, 1)))
    margin = 3.0 / accuracy

    # In groups so small that the margin is only a few ranks, the bracket is the whole range.
    small = F.count(F.lit(1)) < 10 / margin

    def sketch(p: float, end: Column) -> Column:
        if p <= 0 or p >= 1:
            return end
        return F.when(small, end).otherwise(F.percentile_approx("_v", p, accuracy))

    cuts = [
        F.struct(sketch(p - margin, F.min("_v")).alias("lo"), sketch(p + margin, F.max("_v")).alias("hi"))
        for p in probs.values()
    ]
    brackets = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array(*cuts).alias("_cuts"))
    joined = join_per_group(seen, brackets, keys, n_groups)
    # Each row goes to the brackets it lies in or below; rows below only add to the count.
    parts = F.filter(
        F.transform(
            "_cuts",
            lambda cut, i: F.struct(
                i.alias("i"),
                F.when(F.col("_v") >= cut["lo"], F.col("_v")).alias("v"),
                (F.col("_v") <= cut["hi"]).alias("used"),
            ),
        ),
        lambda part: part["used"],
    )
    merged = (
        joined.select(*keys, "_n", F.explode(parts).alias("_p"))
        .groupBy(*keys, F.col("_p.i").alias("_i"), F.col("_p.v").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    )
    # NULL (everything below the bracket) sorts first.
    order = Window.partitionBy(*keys, "_i").orderBy("_v")
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("_i") + 1)
    place = prob * (F.col("_n") - 1)
    ranked = merged.withColumns({"_upto": upto, "_place": place})

    def value_at(rank: Column) -> Column:
        inside = (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
        found = F.max(F.when(inside, F.col("_v")))
        return F.coalesce(found, F.raise_error(F.lit("quantile outside its bracket")).cast("double"))

    per_prob = ranked.groupBy(*keys, "_i").agg(
        value_at(F.floor("_place")).alias("_lo"),
        value_at(F.ceil("_place")).alias("_hi"),
        F.max(F.col("_place") - F.floor("_place")).alias("_above"),
        F.max(F.ceil("_place") - F.col("_place")).alias("_below"),
    )
    # The order of operations of `percentile`, so both routes agree to the last bit.
    between = F.col("_below") * F.col("_lo") + F.col("_above") * F.col("_hi")
    exact = per_prob.withColumn("_q", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between))
    return exact.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(probs)]
    )

