"""Queries: splits, scaling, models, blends and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import inputs as I
from tidemill.catalog.registry import registry
from tidemill.catalog.series import clean_panel_of_orders
from tidemill.functions.calendar import with_calendar, with_cycles
from tidemill.functions.timecols import DAY, epoch_micros
from tidemill.models import regressors as R
from tidemill.models.compress import Compressor
from tidemill.models.forecaster import PREDICTION, Forecaster
from tidemill.models.knn import NeighbourForecaster, distance_mean, nearest, uniform_mean
from tidemill.models.quantile import QUANTILES, fit_interval, load_interval, predict_interval, residual_interval as band_from_errors, save_interval, tune_interval
from tidemill.models.search import boost_with_early_stop, draw, expand_grid, search, store_params, stored_params
from tidemill.operators import blend as B, filters, metrics as M, split as X
from tidemill.operators.features import lag_and_rolling
from tidemill.operators.joins import stack_predictions
from tidemill.operators.scale import fit_scaler
from tidemill.plans.panel import panel_features
from tidemill.plans.training import prepare, tune_and_refit
from tidemill.session import scratch_path
from tidemill.sources.tables import kept, materialise

QUERIES, ORACLES, query = registry()

# --- splits -----------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey, CASE WHEN o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 1 YEAR FROM orders) THEN 'test' ELSE 'train' END AS split FROM orders"
)
def split_years(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return X.split_years(orders, "o_orderdate", 1).drop("o_orderdate")


def _tail_sql(n: str) -> str:
    return (
        "WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events) "
        f"SELECT event_id, CASE WHEN i > n - {n} THEN 'test' ELSE 'train' END AS split FROM o"
    )


@query(_tail_sql("CAST(floor(0.1 * n) AS BIGINT)"))
def split_ratio(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events").select("event_id", "ts")
    return X.split_ratio(ev, "ts", ["event_id"], 0.1).drop("ts")


@query(_tail_sql("8640"))
def split_tail_rows(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events").select("event_id", "ts")
    return X.split_tail(ev, "ts", ["event_id"], 12 * 30 * 24).drop("ts")


_THREE_WAY = (
    "t AS (SELECT max(o_orderdate) - INTERVAL 1 YEAR AS c FROM orders), "
    "w AS (SELECT max(o_orderdate) - INTERVAL 1 YEAR AS c FROM orders WHERE o_orderdate < (SELECT c FROM t)), "
    "p AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate >= t.c THEN 'test' WHEN o_orderdate >= w.c THEN 'val' ELSE 'train' END AS split FROM orders, t, w)"
)


@query(f"WITH {_THREE_WAY} SELECT o_orderkey, split FROM p")
def split_three_way(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return X.split_three_way(orders, "o_orderdate").drop("o_orderdate")


@query(f"WITH {_THREE_WAY} SELECT split, count(*) AS n_rows, min(o_orderdate) AS first_time, max(o_orderdate) AS last_time FROM p GROUP BY 1")
def split_report(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return X.split_report(X.split_three_way(orders, "o_orderdate"), "o_orderdate")


_FOLDS = (
    "o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events), "
    "f AS (SELECT event_id, CAST(greatest(0, 5 - (n - 1 - i) // (n // 6)) AS INTEGER) AS block FROM o)"
)


@query(f"WITH {_FOLDS} SELECT event_id, block FROM f")
def expanding_folds(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events").select("event_id", "ts")
    return X.expanding_folds(ev, "ts", ["event_id"], 5).drop("ts")


# --- scaling ----------------------------------------------------------------------------------

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
_CUT = "(SELECT max(l_shipdate) - INTERVAL 1 YEAR FROM lineitem)"


def _scaled(spark, sf_dir, kind):
    """Fit on the training years, applied to all rows; the tax column passes through unscaled."""
    items = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *_FEATURES, "l_tax")
    split = X.split_years(items, "l_shipdate", 1)
    scaler = fit_scaler(split.where("split = 'train'"), [*_FEATURES, "l_tax"], kind, skip=["l_tax"])
    out = scaler.transform(split)
    return out.select("l_orderkey", "l_linenumber", "l_tax", *[F.round(c, 6).alias(c) for c in _FEATURES])


def _scaled_sql(center: str, scale: str) -> str:
    params = ", ".join(f"{center.format(c=c)} AS m{i}, {scale.format(c=c)} AS s{i}" for i, c in enumerate(_FEATURES))
    out = ", ".join(f"round(({c} - m{i}) / s{i}, 6) AS {c}" for i, c in enumerate(_FEATURES))
    return f"WITH p AS (SELECT {params} FROM lineitem WHERE l_shipdate < {_CUT}) SELECT l_orderkey, l_linenumber, l_tax, {out} FROM lineitem, p"


@query(_scaled_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query(_scaled_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query(
    f"WITH {I.FORECASTS}, p AS (SELECT avg(y) AS m, stddev_pop(y) AS s, min(y) AS lo, max(y) - min(y) AS r FROM fc) "
    "SELECT ts, round((y - m) / s, 6) AS standard, round((y - lo) / r, 6) AS minmax, round(y / 60000, 6) AS divide, round(y, 2) AS back FROM fc, p"
)
def target_scale_inverse(spark, sf_dir):
    fc = I.forecasts(spark, sf_dir).select("ts", "y")
    scalers = {kind: fit_scaler(fc, ["y"], kind) for kind in ("standard", "minmax", "divide")}
    for kind, scaler in scalers.items():
        fc = scaler.transform(fc, {"y": kind})
    fc = scalers["standard"].inverse(fc.withColumn("back", F.col("standard")), {"back": "y"})
    return fc.select("ts", *[F.round(c, 6).alias(c) for c in scalers], F.round("back", 2).alias("back"))


# --- blends -----------------------------------------------------------------------------------

_WEIGHTS = "w AS (SELECT unnest(range(0, 1001)) / 1000 AS weight)"


@query(
    f"WITH {I.FORECASTS}, {_WEIGHTS}, l AS (SELECT weight, avg((y - (weight * a + (1 - weight) * b)) ** 2) AS mse FROM fc, w GROUP BY weight) "
    "SELECT weight, round(sqrt(mse), 4) AS rmse FROM l ORDER BY mse, weight LIMIT 1"
)
def blend_weight_rmse(spark, sf_dir):
    best = B.best_weight_rmse(I.forecasts(spark, sf_dir), "y", "a", "b")
    return best.select("weight", F.round("rmse", 4).alias("rmse"))


_Q3 = {"lower": 0.01, "median": 0.5, "upper": 0.99}


def _pinball_sql(q: float) -> str:
    e = "(y - (weight * a + (1 - weight) * {c}))"
    return f"avg(greatest({q} * {e}, ({q} - 1) * {e}))"


_PINBALL = ", ".join(
    f"l_{n} AS (SELECT weight, {_pinball_sql(q).format(c=n)} AS loss FROM iv, w GROUP BY weight)" for n, q in _Q3.items()
)
_BEST = " UNION ALL ".join(
    f"(SELECT '{n}' AS quantile, weight, round(loss, 4) AS pinball FROM l_{n} ORDER BY loss, weight LIMIT 1)" for n in _Q3
)


@query(f"WITH {I.INTERVALS}, {_WEIGHTS}, {_PINBALL} {_BEST}")
def blend_weight_pinball(spark, sf_dir):
    """Last week's value blended with each bound of an interval forecast."""
    rows = B.per_quantile(I.intervals(spark, sf_dir), "y", {name: ("a", name, q) for name, q in _Q3.items()})
    best = B.best_weight_pinball(rows, "y", "a", "b", "q", ["quantile"])
    return best.withColumn("pinball", F.round("pinball", 4))


@query(f"WITH {I.FORECASTS} SELECT ts, round(0.25 * a + (1 - 0.25) * b, 4) AS blended FROM fc")
def blend_apply(spark, sf_dir):
    return I.forecasts(spark, sf_dir).select("ts", F.round(B.blend("a", "b", 0.25), 4).alias("blended"))


# --- scores -----------------------------------------------------------------------------------


@query(
    f"WITH {I.FORECASTS} SELECT round(sqrt(avg((a - y) ** 2)), 4) AS rmse, round(avg(abs(a - y)), 4) AS mae, "
    "round(avg(CASE WHEN y <> 0 THEN abs(a - y) / abs(y) END) * 100, 6) AS mape, round(stddev_pop(a - y), 4) AS sd, count(*) FILTER (WHERE y = 0) AS n_zero_actual FROM fc"
)
def metrics_point(spark, sf_dir):
    row = M.point_metrics(I.forecasts(spark, sf_dir), "y", "a")
    digits = {"rmse": 4, "mae": 4, "mape": 6, "sd": 4}
    return row.select(*[F.round(c, d).alias(c) for c, d in digits.items()], "n_zero_actual")


@query(f"WITH {I.FORECASTS} SELECT round(1 - sum((b - y) ** 2) / (count(*) * var_pop(y)), 6) AS r2 FROM fc")
def metrics_r2(spark, sf_dir):
    return I.forecasts(spark, sf_dir).agg(F.round(M.r2("y", "b"), 6).alias("r2"))


@query(
    f"WITH {I.FORECASTS} SELECT round(avg(2 * abs(a - y) / CASE WHEN abs(a) + abs(y) = 0 THEN 1e-8 ELSE abs(a) + abs(y) END) * 100, 6) AS smape, "
    "round(avg(abs((a - y) / (y + 1e-8))) * 100, 6) AS mape_shifted FROM fc"
)
def metrics_smape(spark, sf_dir):
    fc = I.forecasts(spark, sf_dir)
    return fc.agg(F.round(M.smape("y", "a"), 6).alias("smape"), F.round(M.mape_shifted("y", "a"), 6).alias("mape_shifted"))


def _pin(c: str, q: float) -> str:
    return f"round(avg(greatest({q} * (y - {c}), ({q} - 1) * (y - {c}))), 4)"


@query(f"WITH {I.INTERVALS} SELECT " + ", ".join(f"{_pin(n, q)} AS {n}" for n, q in _Q3.items()) + " FROM iv")
def metrics_pinball(spark, sf_dir):
    return I.intervals(spark, sf_dir).agg(*[F.round(M.pinball("y", n, q), 4).alias(n) for n, q in _Q3.items()])


_INTERVAL_SQL = (
    "round(avg(CASE WHEN y BETWEEN lower AND upper THEN 1 ELSE 0 END) * 100, 6) AS picp, round(avg(upper - lower), 4) AS mpiw, "
    f"{_pin('lower', 0.01)} AS pinball_lower, {_pin('median', 0.5)} AS pinball_median, {_pin('upper', 0.99)} AS pinball_upper"
)


@query(f"WITH {I.INTERVALS} SELECT {_INTERVAL_SQL} FROM iv")
def metrics_interval(spark, sf_dir):
    row = M.interval_metrics(I.intervals(spark, sf_dir), "y", "lower", "median", "upper")
    return row.select(F.round("picp", 6).alias("picp"), *[F.round(c, 4).alias(c) for c in ("mpiw", "pinball_lower", "pinball_median", "pinball_upper")])


_BY_YEAR = "f AS (SELECT year(ts) AS fold, sqrt(avg((a - y) ** 2)) AS rmse, avg(abs(a - y)) AS mae, avg(CASE WHEN y <> 0 THEN abs(a - y) / abs(y) END) * 100 AS mape, stddev_pop(a - y) AS sd FROM fc GROUP BY 1)"


@query(f"WITH {I.FORECASTS}, {_BY_YEAR} SELECT round(avg(rmse), 4) AS cv_rmse, round(avg(mae), 4) AS cv_mae, round(avg(mape), 6) AS cv_mape, round(avg(sd), 4) AS cv_sd FROM f")
def metrics_cv(spark, sf_dir):
    fc = I.forecasts(spark, sf_dir).withColumn("fold", F.year("ts"))
    row = M.fold_means(fc, "y", "a", "fold")
    return row.select(*[F.round(c, 6 if c == "cv_mape" else 4).alias(c) for c in row.columns])


@query(
    f"WITH {I.FORECASTS}, m AS (SELECT 'last_week' AS model, y, a AS p FROM fc UNION ALL SELECT 'week_mean', y, b FROM fc UNION ALL "
    "SELECT 'blend', y, 0.25 * a + (1 - 0.25) * b FROM fc) SELECT model, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, "
    "round(1 - sum((p - y) ** 2) / (count(*) * var_pop(y)), 6) AS r2 FROM m GROUP BY 1"
)
def leaderboard(spark, sf_dir):
    fc = I.forecasts(spark, sf_dir).withColumn("mix", B.blend("a", "b", 0.25))
    long = stack_predictions(fc, ["ts"], "y", {"last_week": "a", "week_mean": "b", "blend": "mix"})
    rows = M.point_metrics(long, "y_true", "y_pred", ["model"], ["rmse", "mae", "r2"])
    return rows.select("model", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query(
    f"WITH {I.FORECASTS}, c AS (SELECT max(ts) - INTERVAL 1 YEAR AS c FROM fc), "
    "r AS (SELECT isodow(ts) - 1 AS weekday, quantile_cont(y - b, 0.01) AS lo, quantile_cont(y - b, 0.99) AS hi FROM fc, c WHERE ts < c.c GROUP BY 1) "
    "SELECT ts, round(b + lo, 4) AS lower, round(b + hi, 4) AS upper FROM fc, c, r WHERE ts >= c.c AND r.weekday = isodow(ts) - 1"
)
def residual_interval(spark, sf_dir):
    fc = X.split_years(kept(I.forecasts(spark, sf_dir).withColumn("weekday", F.weekday("ts")), "forecasts"), "ts", 1)
    banded = band_from_errors(fc.where("split = 'train'"), fc.where("split = 'test'"), "y", "b", "weekday")
    return banded.select("ts", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


# --- models -----------------------------------------------------------------------------------

_LAGS = (1, 2, 7, 14, 28)
_INPUTS = [
    *(f"v_lag_{k}" for k in _LAGS), "v_mean_7", "v_mean_28", "is_weekend", "weekday_sin", "weekday_cos", "month_sin", "month_cos",
]
_SCALED_INPUTS = [c for c in _INPUTS if c.startswith("v_")]


def _daily_rows(spark, sf_dir):
    """Features of the daily series, written once: models read them many times."""
    base = lag_and_rolling(I.daily_filled(spark, sf_dir), [], "ts", "v", _LAGS, (7, 28), DAY)
    rows = with_cycles(with_calendar(base, "ts")).dropna("any")
    return materialise(rows, scratch_path(spark, "features"))


_UNSCALED = [c for c in _INPUTS if c not in _SCALED_INPUTS]


def _daily_features(spark, sf_dir):
    """The daily rows split by years and scaled by what the training rows show."""
    rows = _daily_rows(spark, sf_dir)
    return prepare(rows, "ts", _INPUTS, "v", _UNSCALED, holdout_years=1, val_years=1).rows


def _parts(df):
    return [df.where(F.col("split") == s) for s in ("train", "val", "test")]


def _forest(features=_INPUTS, **params):
    return Forecaster(R.random_forest(**params), features, "v")


def _boosted(n_estimators=20, **params):
    return Forecaster(R.gradient_boosting(n_estimators=n_estimators, **params), _INPUTS, "v", "standard")


def _scored(model, test):
    return model.predict(test).select("ts", F.col("v").alias("y"), F.col(PREDICTION).alias("prediction"))


@query()
def rf_forecast(spark, sf_dir):
    train, val, test = _parts(_daily_features(spark, sf_dir))
    return _scored(_forest(n_estimators=30, max_depth=8).fit(train.unionByName(val)), test)


@query()
def gbt_forecast(spark, sf_dir):
    train, val, test = _parts(_daily_features(spark, sf_dir))
    return _scored(_boosted(20).fit(train.unionByName(val)), test)


@query()
def robust_linear_forecast(spark, sf_dir):
    train, val, test = _parts(_daily_features(spark, sf_dir))
    model = Forecaster(R.robust_linear(), _INPUTS, "v", "standard")
    return _scored(model.fit(train.unionByName(val)), test)


@query()
def rff_forecast(spark, sf_dir):
    train, val, test = _parts(_daily_features(spark, sf_dir))
    kernel = R.FourierFeatures(gamma=1.0 / len(_INPUTS), size=128)
    model = Forecaster(R.robust_linear(), _INPUTS, "v", "standard", expand=[kernel])
    return _scored(model.fit(train.unionByName(val)), test)


@query(
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label::DOUBLE AS y FROM embeddings), "
    "d AS (SELECT a.vec_id, b.y, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.x[i] - b.x[i]) ** 2))) AS dist, b.vec_id AS other FROM e a JOIN e b ON a.vec_id <> b.vec_id), "
    "t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) <= 5) "
    "SELECT vec_id, round(avg(y), 6) AS uniform, round(CASE WHEN min(dist) = 0 THEN avg(y) FILTER (WHERE dist = 0) "
    "ELSE sum(y / dist) FILTER (WHERE dist > 0) / sum(1 / dist) FILTER (WHERE dist > 0) END, 6) AS by_distance FROM t GROUP BY 1"
)
def knn_forecast(spark, sf_dir):
    """Leave-one-out regression of the label on the vector."""
    vectors = I.table(spark, sf_dir, "embeddings")
    near = nearest(vectors, vectors, "embedding", "vec_id", "label", k=5, exclude_self=True)
    return near.groupBy("vec_id").agg(F.round(uniform_mean(), 6).alias("uniform"), F.round(distance_mean(), 6).alias("by_distance"))


# The daily rows and their splits: y, the cuts of validation and test.
_DAILY_SPLIT = (
    f"{I.DAILY_FILLED}, dx AS (SELECT ts, v AS y, count(v) OVER (ORDER BY ts ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS nb, "
    + ", ".join(f"lag(v, {k}) OVER (ORDER BY ts) AS l{k}" for k in _LAGS)
    + " FROM dfill), dr AS (SELECT * FROM dx WHERE y IS NOT NULL AND nb = 28), tc AS (SELECT max(ts) - INTERVAL 1 YEAR AS c FROM dr)"
)

_NEAR = ", ".join(f"avg(l{k}) AS m{k}, stddev_pop(l{k}) AS s{k}" for k in (1, 7, 14))
_NEAR_SCALED = ", ".join(f"(l{k} - m{k}) / s{k} AS x{k}" for k in (1, 7, 14))


@query(
    f"WITH {_DAILY_SPLIT}, p AS (SELECT {_NEAR} FROM dr, tc WHERE ts < c), z AS (SELECT ts, y, ts < c AS old, {_NEAR_SCALED} FROM dr, p, tc), "
    f"d AS (SELECT a.ts, any_value(a.y) OVER (PARTITION BY a.ts) AS y, b.y AS v, b.ts AS other, {' + '.join(f'abs(a.x{k} - b.x{k})' for k in (1, 7, 14))} AS dist "
    "FROM z a JOIN z b ON NOT a.old AND b.old), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ts ORDER BY dist, other) <= 5) "
    "SELECT ts, any_value(y) AS y, round(CASE WHEN min(dist) = 0 THEN avg(v) FILTER (WHERE dist = 0) "
    "ELSE sum(v / dist) FILTER (WHERE dist > 0) / sum(1 / dist) FILTER (WHERE dist > 0) END, 2) AS prediction FROM t GROUP BY 1"
)
def knn_daily_forecast(spark, sf_dir):
    """k-NN on scaled lags: the held-out year from all days before it."""
    lags = ["v_lag_1", "v_lag_7", "v_lag_14"]
    rows = _daily_rows(spark, sf_dir).select("ts", "v", *lags).withColumn("day", epoch_micros("ts"))
    data = prepare(rows, "ts", lags, "v", holdout_years=1)
    model = NeighbourForecaster(lags, "v", "day", k=5, weights="distance", p=1).fit(data.train)
    return _scored(model, data.test).withColumn("prediction", F.round("prediction", 2))


@query()
def knn_search_cv(spark, sf_dir):
    """k x weights x distance over expanding folds."""
    lags = ["v_lag_1", "v_lag_7", "v_lag_14"]
    rows = _daily_rows(spark, sf_dir).select("ts", "v", *lags).withColumn("day", epoch_micros("ts"))
    data = prepare(rows, "ts", lags, "v", holdout_years=1)
    grid = expand_grid({"k": [3, 5, 10], "weights": ["uniform", "distance"], "p": [1, 2]})
    return search(data.train, "ts", [], lambda p: NeighbourForecaster(lags, "v", "day", **p), grid, n_splits=2, scores=("rmse", "mae")).table


@query(
    f"WITH {_DAILY_SPLIT} SELECT ts, y, " + ", ".join(f"0.0::DOUBLE AS gap_{n}" for n in QUANTILES) + " FROM dr, tc WHERE ts >= c"
)
def quantile_tuned_small(spark, sf_dir):
    """Settings per quantile drawn and scored by pinball loss, stored and read again, refitted with early
    stopping, saved and loaded: how far the loaded models' bounds lie from the fitted ones. Small: 2 draws,
    2 folds, 3 rounds in the search and up to 12 with a patience of 4 in the refit.
    """
    train, val, test = _parts(_daily_features(spark, sf_dir))
    space = {"max_depth": ("int", 2, 4), "learning_rate": ("log", 0.1, 0.5), "colsample_bytree": ("real", 0.6, 1.0)}
    params = tune_interval(train.unionByName(val), "ts", [], _INPUTS, "v", space, n_iter=2, n_splits=2, n_estimators=3)
    folder = scratch_path(spark, "quantiles")
    store_params(spark, params, f"{folder}/params")
    models = fit_interval(train, _INPUTS, "v", stored_params(spark, f"{folder}/params"), val, n_estimators=12, patience=4)
    save_interval(models, spark, f"{folder}/models")
    loaded = predict_interval(load_interval(spark, f"{folder}/models"), test).select("ts", *[F.col(n).alias(f"again_{n}") for n in QUANTILES])
    both = predict_interval(models, test).join(loaded, "ts")
    return both.select("ts", F.col("v").alias("y"), *[F.round(F.abs(F.col(n) - F.col(f"again_{n}")), 6).alias(f"gap_{n}") for n in QUANTILES])


@query()
def quantile_gbt(spark, sf_dir):
    train, val, test = _parts(_daily_features(spark, sf_dir))
    models = fit_interval(train.unionByName(val), _INPUTS, "v", n_estimators=4, max_depth=3, learning_rate=0.3)
    return predict_interval(models, test).select("ts", F.col("v").alias("y"), "lower", "median", "upper")


def _vector_columns(spark, sf_dir):
    vectors = I.table(spark, sf_dir, "embeddings")
    names = [f"x{i}" for i in range(64)]
    return vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query()
def pca_codes(spark, sf_dir):
    rows, names = _vector_columns(spark, sf_dir)
    return Compressor(names, 8).fit(rows).encode(rows).select("vec_id", *[f"code_{i}" for i in range(8)])


@query()
def pca_reconstruction_error(spark, sf_dir):
    rows, names = _vector_columns(spark, sf_dir)
    return M.reconstruction_metrics(Compressor(names, 8).fit(rows).reconstruct(rows), "original", "rebuilt")


@query()
def pca_codes_forecast(spark, sf_dir):
    """Codes of the features in place of the features, into a forest."""
    train, val, test = _parts(_daily_features(spark, sf_dir))
    codes = Compressor(_INPUTS, 8).fit(train)
    model = _forest([f"code_{i}" for i in range(8)], n_estimators=20, max_depth=6)
    return _scored(model.fit(codes.encode(train)), codes.encode(test))


@query(f"WITH {_DAILY_SPLIT} SELECT ts, y, 0.0::DOUBLE AS gap FROM dr, tc WHERE ts >= c")
def model_save_load(spark, sf_dir):
    """How far predictions of a model and of its saved and loaded copy lie apart."""
    train, _, test = _parts(_daily_features(spark, sf_dir))
    model = _boosted(5).fit(train)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    loaded = Forecaster.load(spark, path)
    both = _scored(model, test).join(_scored(loaded, test).select("ts", F.col("prediction").alias("loaded")), "ts")
    return both.select("ts", "y", F.round(F.abs(F.col("prediction") - F.col("loaded")), 6).alias("gap"))


@query()
def batch_score(spark, sf_dir):
    """A stored model over the whole table."""
    rows = _daily_features(spark, sf_dir)
    path = scratch_path(spark, "model")
    _forest(n_estimators=10, max_depth=5).fit(rows.where("split = 'train'")).save(spark, path)
    return _scored(Forecaster.load(spark, path), rows)


@query()
def grid_search_cv(spark, sf_dir):
    """Conditional grid (the kernel width only with the kernel) over expanding folds."""
    train, val, _ = _parts(_daily_features(spark, sf_dir))
    grid = expand_grid([{"kernel": ["linear"], "C": [0.1, 1.0]}, {"kernel": ["rbf"], "C": [1.0], "gamma": [0.1]}])

    def make(p):
        expand = [R.FourierFeatures(gamma=p["gamma"], size=64)] if p["kernel"] == "rbf" else []
        return Forecaster(R.robust_linear(C=p["C"], max_iter=20), _INPUTS, "v", "standard", expand=expand)

    return search(train.unionByName(val), "ts", [], make, grid).table


@query()
def random_search_cv(spark, sf_dir):
    """Random settings scored by pinball loss of the median."""
    train, val, _ = _parts(_daily_features(spark, sf_dir))
    space = {"max_depth": ("int", 2, 4), "learning_rate": ("log", 0.05, 0.3), "subsample": ("real", 0.6, 1.0)}

    def loss(predicted):
        return predicted.agg(M.pinball("v", PREDICTION, 0.5)).first()[0]

    found = search(
        train.unionByName(val), "ts", [], lambda p: _boosted(5, **p), draw(space, 2), n_splits=3, refit="pinball", score=loss
    )
    return found.table


@query()
def gbt_early_stop(spark, sf_dir):
    """Loss per round on train and validation, with the kept round marked."""
    train, val, _ = _parts(_daily_features(spark, sf_dir))
    found = boost_with_early_stop(lambda n: _boosted(n, max_depth=3), train, val, max_iter=20, patience=5)
    return found.losses.withColumn("best_iteration", F.lit(found.best_iteration))


@query()
def tune_older_refit_newer(spark, sf_dir):
    """Settings chosen with the last three years held out, model refitted with one year held out."""
    rows = _daily_rows(spark, sf_dir)
    older, final = (prepare(rows, "ts", _INPUTS, "v", _UNSCALED, holdout_years=n) for n in (3, 1))
    make = lambda p: Forecaster(R.robust_linear(max_iter=20, **p), _INPUTS, "v", "standard")
    model, _ = tune_and_refit(older, final, "ts", [], make, expand_grid({"C": [0.1, 10.0]}), n_splits=3)
    return _scored(model, final.test)


@query()
def panel_forecast(spark, sf_dir):
    """One model for a panel of series; one series' year is held out and scored in its own unit.

    The target is learnt as log(1 + v); the held-out rows are scaled with the training rows'
    parameters.
    """
    panel = panel_features(clean_panel_of_orders(spark, sf_dir), "series", "ts", "power", ["temperature"], (1, 7, 28), DAY)
    rows = with_cycles(panel)
    held_out = (F.col("series") == "1-URGENT") & (F.year("ts") == 2000)
    stored = materialise(rows.withColumn("held_out", F.coalesce(held_out, F.lit(False))), scratch_path(spark, "panel"))
    test, train = filters.split_by_mask(stored, F.col("held_out"))
    scaled = ["temperature", "power_lag_1", "power_lag_7", "power_lag_28"]
    scaler = fit_scaler(train, scaled)
    features = [*scaled, "is_weekend", "weekday_sin", "weekday_cos", "month_sin", "month_cos"]
    model = Forecaster(R.gradient_boosting(n_estimators=10), features, "power", "log1p").fit(scaler.transform(train))
    scored = model.predict(scaler.transform(test))
    row = M.point_metrics(scored, "power", PREDICTION, scores=("rmse", "mae", "sd", "r2", "smape"))
    return row.withColumn("mape", scored.agg(M.mape_shifted("power", PREDICTION)).scalar())


_FAMILIES = {
    "scaled": {"lower": "b * 0.6::DOUBLE", "median": "b", "upper": "b * 1.4::DOUBLE"},
    "shifted": {"lower": "a * 0.5::DOUBLE", "median": "a", "upper": "a * 1.5::DOUBLE"},
}
_FAMILY_COLUMNS = ", ".join(f"{e} AS {f}_{n}" for f, cols in _FAMILIES.items() for n, e in cols.items())


def _ensemble_sql() -> str:
    losses, picks = [], []
    for n, q in _Q3.items():
        e = f"(y - (weight * scaled_{n} + (1 - weight) * shifted_{n}))"
        losses.append(f"l_{n} AS (SELECT weight, avg(greatest({q} * {e}, ({q} - 1) * {e})) AS loss FROM f, w WHERE split = 'val' GROUP BY weight)")
        picks.append(f"p_{n} AS (SELECT weight AS w_{n} FROM l_{n} ORDER BY loss, weight LIMIT 1)")
    mixed = ", ".join(f"w_{n} * scaled_{n} + (1 - w_{n}) * shifted_{n} AS {n}" for n in _Q3)
    plain = [f"SELECT '{f}' AS model, y, " + ", ".join(f"{f}_{n} AS {n}" for n in _Q3) + " FROM t" for f in _FAMILIES]
    scores = (
        "round(avg(CASE WHEN y BETWEEN lower AND upper THEN 1 ELSE 0 END) * 100, 6) AS picp, round(avg(upper - lower), 4) AS mpiw, "
        f"{_pin('lower', 0.01)} AS pinball_lower, {_pin('median', 0.5)} AS pinball_median, {_pin('upper', 0.99)} AS pinball_upper"
    )
    cut = "SELECT max(ts) - INTERVAL 1 YEAR AS c FROM fc"
    return (
        f"WITH {I.FORECASTS}, {_WEIGHTS}, c1 AS ({cut}), c2 AS ({cut} WHERE ts < (SELECT c FROM c1)), "
        f"f AS (SELECT ts, y, CASE WHEN ts >= c1.c THEN 'test' WHEN ts >= c2.c THEN 'val' ELSE 'train' END AS split, {_FAMILY_COLUMNS} FROM fc, c1, c2), "
        f"{', '.join(losses + picks)}, t AS (SELECT * FROM f WHERE split = 'test'), "
        f"m AS ({' UNION ALL '.join(plain)} UNION ALL SELECT 'ensemble', y, {mixed} FROM t, p_lower, p_median, p_upper) "
        f"SELECT model, round(sqrt(avg((median - y) ** 2)), 4) AS rmse, {scores} FROM m GROUP BY 1"
    )


@query(_ensemble_sql())
def interval_ensemble(spark, sf_dir):
    """Two interval forecasts blended per quantile with weights from validation rows; scores of
    both and of the blend on test rows."""
    exprs = [F.expr(e.replace("::DOUBLE", "D")).alias(f"{f}_{n}") for f, cols in _FAMILIES.items() for n, e in cols.items()]
    rows = X.split_three_way(I.forecasts(spark, sf_dir).select("ts", "y", *exprs), "ts")
    stored = materialise(rows, scratch_path(spark, "intervals"))
    pairs = {n: (f"scaled_{n}", f"shifted_{n}", q) for n, q in _Q3.items()}
    val = B.per_quantile(stored.where("split = 'val'"), "y", pairs)
    weights = {r["quantile"]: r["weight"] for r in B.best_weight_pinball(val, "y", "a", "b", "q", ["quantile"]).collect()}
    mixed = {f"ensemble_{n}": B.blend(a, b, weights[n]) for n, (a, b, _) in pairs.items()}
    test = stored.where("split = 'test'").withColumns(mixed)
    models = [
        F.struct(F.lit(m).alias("model"), *[F.col(f"{m}_{n}").alias(n) for n in _Q3]) for m in (*_FAMILIES, "ensemble")
    ]
    long = test.select("y", F.explode(F.array(*models)).alias("_m")).select("y", "_m.*")
    bands = M.interval_metrics(long, "y", "lower", "median", "upper", by=["model"])
    points = M.point_metrics(long, "y", "median", ["model"], ["rmse"]).select("model", "rmse")
    joined = points.join(bands, "model")
    return joined.select("model", F.round("picp", 6).alias("picp"), *[F.round(c, 4).alias(c) for c in joined.columns if c not in ("model", "picp")])


@query()
def ensemble_leaderboard(spark, sf_dir):
    """Two models with searched and stored settings, their blend weight from validation rows, and scores of
    all three on test. The searches try two settings each on two folds.
    """
    train, val, test = _parts(_daily_features(spark, sf_dir))
    makers = {"forest": lambda p: _forest(n_estimators=20, **p), "boosted": lambda p: _boosted(10, **p)}
    grids = {"forest": {"max_depth": [4, 8]}, "boosted": {"max_depth": [2, 4]}}
    best = {m: search(train, "ts", [], make, expand_grid(grids[m]), n_splits=2, scores=("rmse",)).best_params for m, make in makers.items()}
    path = scratch_path(spark, "params")
    store_params(spark, best, path)
    models = {m: makers[m](p).fit(train) for m, p in stored_params(spark, path).items()}

    def both(rows):
        for name, model in models.items():
            rows = model.predict(rows).withColumnRenamed(PREDICTION, name)
        return rows.select("ts", "v", *models)

    weight = B.best_weight_rmse(both(val), "v", "forest", "boosted").first()["weight"]
    scored = both(test).withColumn("blend", B.blend("forest", "boosted", weight))
    long = stack_predictions(scored, ["ts"], "v", {m: m for m in (*models, "blend")})
    return M.point_metrics(long, "y_true", "y_pred", ["model"], ["rmse", "mae", "mape", "sd", "r2"]).withColumn("weight_forest", F.lit(weight))
