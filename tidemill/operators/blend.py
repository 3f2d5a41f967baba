"""Two-model blends: weight search and application.

`weight` is the share of model a; candidates are 0, 0.001, ..., 1 and the first best one wins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

STEPS = 1_000


def _weights(name: str = "_i") -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias(name)


def blend(a: str, b: str, weight: Column | float) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return weight * F.col(a) + (1 - weight) * F.col(b)


def best_weight_rmse(df: DataFrame, y: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, weight, rmse). The squared error is a parabola in the weight, so three sums suffice."""
    d, e = F.col(a) - F.col(b), F.col(y) - F.col(b)
    sums = df.groupBy(*by).agg(
        F.sum(d * d).alias("_dd"), F.sum(d * e).alias("_de"), F.sum(e * e).alias("_ee"), F.count(d * e).alias("_n")
    )
    w = F.col("_i") / STEPS
    sse = w * w * F.col("_dd") - 2 * w * F.col("_de") + F.col("_ee")
    tried = sums.select("*", _weights()).withColumn("_sse", F.greatest(sse, F.lit(0.0)))
    best = F.min(F.struct("_sse", "_i", "_n"))
    return tried.groupBy(*by).agg(best.alias("_b")).select(
        *by, (F.col("_b._i") / STEPS).alias("weight"), F.sqrt(F.col("_b._sse") / F.col("_b._n")).alias("rmse")
    )


def per_quantile(df: DataFrame, y: str, pairs: Mapping[str, tuple[str, str, float]], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, quantile): `quantile, y, a, b, q` for name -> (column a, column b, q)."""
    parts = [
        F.struct(F.lit(name).alias("quantile"), F.col(a).alias("a"), F.col(b).alias("b"), F.lit(q).alias("q"))
        for name, (a, b, q) in pairs.items()
    ]
    return df.select(*keep, F.col(y).alias("y"), F.explode(F.array(*parts)).alias("_p")).select(*keep, "y", "_p.*")


def best_weight_pinball(
    df: DataFrame, y: str, a: str, b: str, q: float | str, by: Sequence[str] = ()
) -> DataFrame:
    """(by, weight, pinball) for the quantile `q` (a number, or a column that is constant per `by`).

    One pass, no candidate-by-row product. A row's loss is linear in the weight on either side of
    the weight at which its error changes sign. Rows are summed up by the first candidate past
    that point; running sums over the at most 1,002 cells then give the loss of every weight.
    """
    q = F.col(q) if isinstance(q, str) else F.lit(q)
    e, d = F.col(y) - F.col(b), F.col(a) - F.col(b)
    # The error e - w d falls with the weight when d > 0 and rises when d < 0.
    first_past = F.when(d == 0, F.lit(STEPS + 1)).otherwise(
        F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(STEPS + 1.0), F.try_divide(e, d) * STEPS)))
    )
    start = F.when((d > 0) | ((d == 0) & (e > 0)), q).otherwise(q - 1)
    end = F.when(d == 0, start).when(d > 0, q - 1).otherwise(q)
    rows = df.where(e.isNotNull() & d.isNotNull()).select(
        *by, first_past.cast("int").alias("_i"), (start * e).alias("_be"), (start * d).alias("_bd"),
        (end * e).alias("_ae"), (end * d).alias("_ad"),
    )
    sums = ["_be", "_bd", "_ae", "_ad"]
    cells = rows.groupBy(*by, "_i").agg(*[F.sum(s).alias(s) for s in sums], F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_i")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = cells.select(
        *by,
        "_i",
        (F.lead("_i", 1, STEPS + 1).over(order) - 1).alias("_to"),
        (F.row_number().over(order) == 1).alias("_first"),
        *[F.sum(s).over(past).alias(s) for s in ("_ae", "_ad")],
        *[F.sum(s).over(whole).alias(f"_all{s}") for s in ("_be", "_bd", "_n")],
        *[F.sum(s).over(past).alias(f"_past{s}") for s in ("_be", "_bd")],
    )

    def stretch(start: Column, stop: Column, counted: bool) -> Column:
        """Weights from..to that share one set of running sums."""
        zero = F.lit(0.0)
        return F.struct(
            start.alias("start"),
            stop.alias("stop"),
            (F.col("_ae") if counted else zero).alias("ae"),
            (F.col("_ad") if counted else zero).alias("ad"),
            (F.col("_all_be") - F.col("_past_be") if counted else F.col("_all_be")).alias("be"),
            (F.col("_all_bd") - F.col("_past_bd") if counted else F.col("_all_bd")).alias("bd"),
        )

    own = stretch(F.col("_i"), F.col("_to"), True)
    head = F.when(F.col("_first"), stretch(F.lit(0), F.col("_i") - 1, False))
    stretches = F.filter(F.array(own, head), lambda s: s.isNotNull() & (s["start"] <= s["stop"]))
    tried = running.select(*by, "_all_n", F.explode(stretches).alias("_s")).select(
        *by, "_all_n", "_s.*", F.explode(F.sequence("_s.start", "_s.stop")).alias("_w")
    )
    w = F.col("_w") / STEPS
    loss = (F.col("ae") - w * F.col("ad") + F.col("be") - w * F.col("bd")) / F.col("_all_n")
    best = F.min(F.struct(loss.alias("_loss"), F.col("_w"))).alias("_b")
    return tried.groupBy(*by).agg(best).select(*by, (F.col("_b._w") / STEPS).alias("weight"), F.col("_b._loss").alias("pinball"))
