"""Queries whose numbers have a closed form: source guards, splits and scalers at their edges, and models so small that
SQL can say what they predict.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import inputs as I
from tidemill.catalog.learning import _DAILY_SPLIT, _INPUTS, _daily_rows
from tidemill.catalog.registry import registry
from tidemill.models import regressors as R, svr as V
from tidemill.models.forecaster import PREDICTION, Forecaster
from tidemill.models.quantile import QUANTILES, fit_interval, load_interval, predict_interval, save_interval
from tidemill.models.search import boost_with_early_stop
from tidemill.operators import metrics as M, split as X
from tidemill.operators.clean import union_by_name
from tidemill.plans.training import prepare
from tidemill.session import scratch_path
from tidemill.sources.tables import usable_sources

QUERIES, ORACLES, query = registry()


@query(
    "SELECT o_orderstatus AS source, count(*) AS n_rows, sum(round(o_totalprice * 100)) AS v FROM orders "
    "WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"
)
def guarded_sources(spark, sf_dir):
    """One source per order status; the one without the value column is skipped, whatever it holds."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderdate").alias("ts"), I.cents("o_totalprice").alias("v"))
    frames = {s: orders.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O", "P")}
    frames["P"] = frames["P"].drop("v")
    kept = usable_sources(frames, ["ts", "v"])
    stacked = union_by_name([df.withColumn("source", F.lit(name)) for name, df in kept.items()])
    return stacked.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("v"))


_LABELLED = (
    f"{_DAILY_SPLIT}, vc AS (SELECT max(ts) - INTERVAL {{years}} YEAR AS v FROM dr, tc WHERE ts < c), "
    "lab AS (SELECT dr.*, CASE WHEN ts >= c THEN 'test' WHEN ts >= v THEN 'val' ELSE 'train' END AS split FROM dr, tc, vc)"
)


@query(f"WITH {_LABELLED.format(years=1)} SELECT ts, y AS v FROM lab WHERE split <> 'test'")
def trainval_union(spark, sf_dir):
    """Training and validation rows as one table again, for the last fit."""
    data = prepare(_daily_rows(spark, sf_dir), "ts", _INPUTS, "v", holdout_years=1, val_years=1)
    return data.trainval.select("ts", "v")


@query(f"WITH {_LABELLED.format(years=0)} SELECT split, count(*) AS n_rows, min(ts) AS first_time, max(ts) AS last_time FROM lab GROUP BY 1")
def split_without_val_years(spark, sf_dir):
    """No validation years: the last time before the test years is all that validation holds."""
    data = prepare(_daily_rows(spark, sf_dir), "ts", _INPUTS, "v", holdout_years=1, val_years=0)
    return X.split_report(data.rows, "ts")


@query(f"WITH {_LABELLED.format(years=1)} SELECT ts, split, l1 AS v_lag_1, l28 AS v_lag_28 FROM lab")
def scale_none(spark, sf_dir):
    """Without a scaler features keep their own unit."""
    data = prepare(_daily_rows(spark, sf_dir), "ts", _INPUTS, "v", holdout_years=1, val_years=1, scaler_type=None)
    return data.rows.select("ts", "split", "v_lag_1", "v_lag_28")


@query(
    "WITH c AS (SELECT l_quantity AS a, round(l_discount * 100) AS b, round(l_tax * 100) AS d FROM lineitem), "
    "r AS (SELECT a, b, d, floor(a / 10) * 10 AS ra, floor(b / 5) * 5 AS rb, floor(d / 5) * 5 AS rd FROM c) "
    "SELECT round(avg(((a - ra) ** 2 + (b - rb) ** 2 + (d - rd) ** 2) / 3), 6) AS recon_mse, "
    "round(avg((abs(a - ra) + abs(b - rb) + abs(d - rd)) / 3), 6) AS recon_mae FROM r"
)
def metrics_reconstruction(spark, sf_dir):
    """Errors over all cells of a rebuilt table; rebuilt here by cutting values to a coarse grid."""
    items = I.table(spark, sf_dir, "lineitem")
    cells = {"a": F.col("l_quantity"), "b": I.cents("l_discount"), "d": I.cents("l_tax")}
    rows = items.select(*[c.alias(n) for n, c in cells.items()])
    coarse = [F.floor(F.col(n) / s) * s for n, s in (("a", 10), ("b", 5), ("d", 5))]
    both = rows.select(F.array("a", "b", "d").alias("original"), F.array(*[c.cast("double") for c in coarse]).alias("rebuilt"))
    out = M.reconstruction_metrics(both, "original", "rebuilt")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_MEAN = "mu AS (SELECT avg(y) AS m FROM lab WHERE split = 'train')"


@query(
    f"WITH {_LABELLED.format(years=1)}, {_MEAN}, l AS (SELECT avg((y - m) ** 2) FILTER (WHERE split = 'train') AS t, "
    "avg((y - m) ** 2) FILTER (WHERE split = 'val') AS v FROM lab, mu) "
    "SELECT i::INT AS iteration, round(t / 1e8, 3) AS train_loss, round(v / 1e8, 3) AS val_loss, 1::INT AS best_iteration FROM l, range(1, 4) r(i)"
)
def loss_table(spark, sf_dir):
    """Losses round by round. Trees without a split stop at the mean of the first round, so patience ends the fit."""
    data = prepare(_daily_rows(spark, sf_dir), "ts", _INPUTS, "v", holdout_years=1, val_years=1)
    make = lambda n: Forecaster(R.gradient_boosting(n, max_depth=0), _INPUTS, "v")
    found = boost_with_early_stop(make, data.train, data.val, 50, 2)
    rounded = [F.round(F.col(c) / 1e8, 3).alias(c) for c in ("train_loss", "val_loss")]
    return found.losses.select("iteration", *rounded, F.lit(found.best_iteration).alias("best_iteration"))


@query(f"WITH {_LABELLED.format(years=1)}, {_MEAN} SELECT ts, y, round(m, 3) AS prediction FROM lab, mu WHERE split = 'test'")
def constant_boosting(spark, sf_dir):
    """What boosting without a split predicts: the training mean, through a model that was saved and loaded."""
    data = prepare(_daily_rows(spark, sf_dir), "ts", _INPUTS, "v", holdout_years=1, val_years=1)
    make = lambda n: Forecaster(R.gradient_boosting(n, max_depth=0), _INPUTS, "v")
    model = boost_with_early_stop(make, data.train, data.val, 2, 1).model
    path = scratch_path(spark, "model")
    model.save(spark, path)
    scored = Forecaster.load(spark, path).predict(data.test)
    return scored.select("ts", F.col("v").alias("y"), F.round(PREDICTION, 3).alias("prediction"))


_HALVES = (
    f"{_LABELLED.format(years=1)}, s AS (SELECT quantile_cont(y, 0.01) AS lower, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.99) AS upper "
    "FROM lab WHERE split <> 'test')"
)


@query(f"WITH {_HALVES} SELECT ts, y, round(lower, 3) AS lower, round(median, 3) AS median, round(upper, 3) AS upper FROM lab, s WHERE split = 'test'")
def constant_quantiles(spark, sf_dir):
    """The three quantile models without a split, saved and loaded: the quantiles of the training rows."""
    data = prepare(_daily_rows(spark, sf_dir), "ts", _INPUTS, "v", holdout_years=1, val_years=1)
    path = scratch_path(spark, "quantiles")
    save_interval(fit_interval(data.trainval, _INPUTS, "v", n_estimators=1, max_depth=0), spark, path)
    out = predict_interval(load_interval(spark, path), data.test)
    return out.select("ts", F.col("v").alias("y"), *[F.round(n, 3).alias(n) for n in QUANTILES])


@query()
def svr_linear_forecast(spark, sf_dir):
    """The held-out year by support vector regression on all days before it."""
    data = prepare(_daily_rows(spark, sf_dir), "ts", _INPUTS, "v", holdout_years=1, val_years=1)
    model = Forecaster(V.support_vectors(1.0, 0.1), _INPUTS, "v", "standard").fit(data.trainval)
    return model.predict(data.test).select("ts", F.col("v").alias("y"), F.col(PREDICTION).alias("prediction"))


@query()
def svr_kernel_forecast(spark, sf_dir):
    """The same with a kernel by landmarks."""
    data = prepare(_daily_rows(spark, sf_dir), "ts", _INPUTS, "v", holdout_years=1, val_years=1)
    kernel = V.NystromFeatures(gamma=1.0 / len(_INPUTS), size=128)
    model = Forecaster(V.support_vectors(10.0, 0.1), _INPUTS, "v", "standard", expand=[kernel]).fit(data.trainval)
    return model.predict(data.test).select("ts", F.col("v").alias("y"), F.col(PREDICTION).alias("prediction"))
