"""Models, blends and searches."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemill.catalog import learning as L
from tidemill.models import regressors as R, svr as V
from tidemill.models.compress import Compressor
from tidemill.models.forecaster import PREDICTION, Forecaster
from tidemill.models.boosting import SquaredBoosting
from tidemill.models.knn import NeighbourForecaster, NeighbourIndex, knn_predict, nearest
from tidemill.models.metric_tree import distances
from tidemill.models.sweep import best_of_block
from tidemill.models.quantile import QuantileBoosting, fit_interval, predict_interval, tune_interval
from tidemill.models.search import ParzenDraws, boost_with_early_stop, draw, expand_grid, search, search_in_turn, store_params, stored_params
from tidemill.operators import blend, metrics as M
from tidemill.operators.split import expanding_folds


@pytest.fixture(scope="module")
def features(spark):
    return L._daily_features(spark, SF).cache()


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (600, 2))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 600)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "ts": pd.date_range("2024-01-01", periods=600, freq="h")})
    df = spark.createDataFrame(pdf)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


@pytest.mark.parametrize("name", ["rf_forecast", "gbt_forecast", "robust_linear_forecast", "rff_forecast"])
def test_models_beat_last_week(spark, features, name):
    out = L.QUERIES[name](spark, SF)
    naive = features.where("split = 'test'").select("ts", F.col("v_lag_7").alias("naive"))
    rows = out.join(naive, "ts")
    score = rows.agg(M.rmse("y", "prediction").alias("m"), M.rmse("y", "naive").alias("n"), F.count_if(F.col("prediction").isNull()).alias("nulls")).first()
    assert score.m < score.n and score.nulls == 0
    assert out.count() == naive.count()


@pytest.mark.parametrize("kind", [None, "standard", "minmax", "divide"])
def test_target_scaling_and_reload(spark, toy, tmp_path, kind):
    model = Forecaster(R.robust_linear(), ["a", "b"], "y", kind, factor=10.0).fit(toy)
    assert model.evaluate(toy).first()["rmse"] < 0.2
    model.save(spark, str(tmp_path / "m"))
    again = Forecaster.load(spark, str(tmp_path / "m"))
    gap = model.predict(toy).select("ts", "prediction").join(again.predict(toy).select("ts", F.col("prediction").alias("p2")), "ts")
    assert gap.agg(F.max(F.abs(F.col("prediction") - F.col("p2")))).first()[0] < 1e-9


def test_log_target(spark, toy):
    positive = toy.withColumn("y", F.exp("y"))
    model = Forecaster(R.random_forest(n_estimators=5, max_depth=4), ["a", "b"], "y", "log1p").fit(positive)
    assert model.predict(positive).where("prediction <= -1").count() == 0


def test_fourier_features_survive_reload(spark, toy, tmp_path):
    curved = toy.withColumn("y", F.sin(F.col("a") * 2))
    kernel = R.FourierFeatures(gamma=0.5, size=64)
    model = Forecaster(R.robust_linear(), ["a", "b"], "y", expand=[kernel]).fit(curved)
    straight = Forecaster(R.robust_linear(), ["a", "b"], "y").fit(curved)
    assert model.evaluate(curved).first()["rmse"] < 0.5 * straight.evaluate(curved).first()["rmse"]
    model.save(spark, str(tmp_path / "m"))
    again = Forecaster.load(spark, str(tmp_path / "m"))
    assert again.evaluate(curved).first()["rmse"] == pytest.approx(model.evaluate(curved).first()["rmse"])


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("rows_per_chunk", [15, 20_000])
def test_neighbours_are_exact(spark, p, rows_per_chunk):
    """Clustered points with a hot cell, repeated points, and distances that tie."""
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(0, 0.05, (150, 3)), rng.normal(5, 1, (60, 3)), np.tile([[1.0, 1.0, 1.0]], (12, 1))]).round(2)
    pdf = pd.DataFrame({"id": np.arange(len(pts)), "y": rng.normal(size=len(pts)), **{f"x{j}": pts[:, j] for j in range(3)}})
    df = spark.createDataFrame(pdf)
    for exclude in (True, False):
        got = nearest(df, df, ["x0", "x1", "x2"], "id", "y", k=4, p=p, exclude_self=exclude, rows_per_chunk=rows_per_chunk).toPandas()
        gap = np.abs(pts[:, None, :] - pts[None, :, :])
        d = gap.sum(2) if p == 1 else np.sqrt((gap * gap).sum(2)) if p == 2 else (gap**p).sum(2) ** (1 / p)
        if exclude:
            np.fill_diagonal(d, np.inf)
        want = d.argsort(axis=1, kind="stable")[:, :4]
        found = got.sort_values(["id", "distance", "neighbour"]).groupby("id")["neighbour"].apply(list)
        assert [sorted(x) for x in found] == [sorted(x) for x in want.tolist()]


def test_neighbours_of_rows_without_a_vector(spark):
    rows = [(1, 0.0, 1.0), (2, 1.0, 2.0), (3, None, 3.0), (None, 5.0, 4.0), (4, 7.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {(r["id"], r["neighbour"]) for r in nearest(df, df, ["x"], "id", "y", k=1, exclude_self=True).collect()}
    assert got == {(1, 2), (2, 1), (4, 2)}
    assert nearest(df.limit(0), df, ["x"], "id", "y").columns == ["id", "neighbour", "distance", "neighbour_target"]
    assert nearest(df.limit(0), df, ["x"], "id", "y").count() == nearest(df, df.limit(0), ["x"], "id", "y").count() == 0


def test_small_tables_are_searched_by_many_tasks(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 1013).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    near = nearest(df, df.where("id % 100 = 0"), ["x"], "id", "y", k=1)
    assert near.where("distance = 0").count() == 200


def test_search_gives_its_cache_back_and_bears_null_scores(spark, toy):
    toy.count()  # cached by itself
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())

    def broken(params):
        raise RuntimeError("no fit")

    with pytest.raises(RuntimeError):
        search(toy, "ts", [], broken, [{}], n_splits=2)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == cached
    zero = toy.withColumn("y", F.lit(0.0))
    made = lambda p: Forecaster(R.robust_linear(**p), ["a", "b"], "y")
    found = search(zero, "ts", [], made, [{}], n_splits=2, scores=("rmse", "mape"))
    assert found.table.first()["cv_mape"] is None and found.best_score == pytest.approx(0)


def test_neighbour_weights(spark):
    rows = [(1, 10, 0.0, 5.0), (1, 11, 1.0, 9.0), (2, 10, 1.0, 4.0), (2, 11, 3.0, 8.0)]
    near = spark.createDataFrame(rows, "id int, neighbour int, distance double, neighbour_target double")
    even = {r.id: r.prediction for r in knn_predict(near, "id").collect()}
    weighted = {r.id: r.prediction for r in knn_predict(near, "id", "distance").collect()}
    assert even == {1: 7, 2: 6}
    assert weighted[1] == 5 and weighted[2] == pytest.approx((4 + 8 / 3) / (1 + 1 / 3))


def _blend_rows(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(100, 20, 400)
    a, b = y + rng.normal(3, 8, 400), y + rng.normal(-5, 6, 400)
    a[:20] = b[:20]
    return spark.createDataFrame(pd.DataFrame({"g": np.arange(400) % 2, "y": y, "a": a, "b": b})), y, a, b


@pytest.mark.parametrize("q", [0.01, 0.5, 0.99])
def test_pinball_weight_matches_trying_all(spark, q):
    df, y, a, b = _blend_rows(spark)
    w = np.arange(1001) / 1000
    e = y - (w[:, None] * a + (1 - w[:, None]) * b)
    loss = np.maximum(q * e, (q - 1) * e)
    best = blend.best_weight_pinball(df, "y", "a", "b", q).first()
    assert best.weight == w[loss.mean(1).argmin()] and best.pinball == pytest.approx(loss.mean(1).min())
    by_group = {r.g: r for r in blend.best_weight_pinball(df, "y", "a", "b", q, ["g"]).collect()}
    for g in (0, 1):
        part = loss[:, g::2].mean(1)
        assert by_group[g].weight == w[part.argmin()] and by_group[g].pinball == pytest.approx(part.min())


def test_rmse_weight_matches_trying_all(spark):
    df, y, a, b = _blend_rows(spark)
    w = np.arange(1001) / 1000
    sse = ((y - (w[:, None] * a + (1 - w[:, None]) * b)) ** 2).mean(1)
    best = blend.best_weight_rmse(df, "y", "a", "b").first()
    assert best.weight == w[sse.argmin()] and best.rmse == pytest.approx(np.sqrt(sse.min()))
    ends = df.agg(M.rmse("y", "a").alias("a"), M.rmse("y", "b").alias("b")).first()
    assert best.rmse <= min(ends.a, ends.b)


def test_first_weight_wins_a_tie(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0)], "y double, a double, b double")
    assert blend.best_weight_rmse(df, "y", "a", "b").first().weight == 0
    assert blend.best_weight_pinball(df, "y", "a", "b", 0.5).first().weight == 0


def test_quantile_boosting(spark, toy):
    train, val = toy.where("ts < timestamp_ntz'2024-01-20'"), toy.where("ts >= timestamp_ntz'2024-01-20'")
    models = fit_interval(train, ["a", "b"], "y", n_estimators=6, max_depth=3, learning_rate=0.5)
    out = predict_interval(models, val).cache()
    assert out.count() == val.count() and out.where("lower IS NULL OR median IS NULL OR upper IS NULL").count() == 0
    row = M.interval_metrics(out, "y", "lower", "median", "upper").first()
    flat = val.withColumn("flat", F.lit(models["median"].start)).agg(M.pinball("y", "flat", 0.5)).first()[0]
    assert row.pinball_median < 0.6 * flat and row.picp > 80


def test_quantile_boosting_stops(spark, toy):
    train, val = toy.where("a < 0"), toy.where("a >= 0")
    model = QuantileBoosting(["b"], "y", 0.5, n_estimators=8, max_depth=2, learning_rate=1.0, patience=2).fit(train, val)
    losses = [v for _, _, v in model.losses]
    assert model.best_iteration == int(np.argmin(losses)) + 1
    assert len(losses) == min(8, model.best_iteration + 2)


def test_early_stop_reports_every_round(spark, toy):
    train, val = toy.where("ts < timestamp_ntz'2024-01-20'"), toy.where("ts >= timestamp_ntz'2024-01-20'")
    found = boost_with_early_stop(lambda n: Forecaster(R.gradient_boosting(n), ["a", "b"], "y"), train, val, 6, 2)
    rows = found.losses.orderBy("iteration").collect()
    assert len(rows) == 6 and rows[0].val_loss > rows[5].val_loss
    assert found.model.regressor.getNumTrees == found.best_iteration


def test_grids_and_draws():
    grid = expand_grid([{"kernel": ["linear"], "C": [1, 2]}, {"kernel": ["rbf"], "C": [1], "gamma": [3, 4]}])
    assert len(grid) == 4 and all("gamma" not in g for g in grid if g["kernel"] == "linear")
    drawn = draw({"depth": ("int", 3, 10), "rate": ("log", 0.01, 0.3), "share": ("real", 0.6, 1.0)}, 50)
    assert drawn == draw({"depth": ("int", 3, 10), "rate": ("log", 0.01, 0.3), "share": ("real", 0.6, 1.0)}, 50)
    assert all(3 <= d["depth"] <= 10 and 0.01 <= d["rate"] <= 0.3 and 0.6 <= d["share"] <= 1 for d in drawn)


def test_search_prefers_the_better_setting(spark, toy):
    def make(p):
        return Forecaster(R.random_forest(n_estimators=3, max_depth=p["max_depth"]), ["a", "b"], "y")

    found = search(toy, "ts", [], make, expand_grid({"max_depth": [0, 5]}), n_splits=3)
    assert found.best_params == {"max_depth": 5}
    table = {r.candidate: r for r in found.table.collect()}
    assert len(table) == 2 and table[1].cv_rmse < table[0].cv_rmse and table[1].cv_rmse == pytest.approx(found.best_score)


def test_compression_rebuilds_what_is_linear(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 2))
    x = base @ rng.normal(size=(2, 5)) + 3
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    comp = Compressor(names, 2).fit(df)
    assert M.reconstruction_metrics(comp.reconstruct(df), "original", "rebuilt").first().recon_mse < 1e-12
    assert M.reconstruction_metrics(Compressor(names, 1).fit(df).reconstruct(df), "original", "rebuilt").first().recon_mse > 1e-3
    assert comp.encode(df).columns == [*names, "code_0", "code_1"]


def test_boosting_stops_where_nothing_is_gained(spark, toy):
    train, val = toy.where("a < 0"), toy.where("a >= 0").withColumn("y", -F.col("y"))
    trained = []

    def make(n):
        trained.append(n)
        return Forecaster(R.gradient_boosting(n), ["b"], "y")

    found = boost_with_early_stop(make, train, val, 200, 2)
    losses = [r.val_loss for r in found.losses.orderBy("iteration").collect()]
    assert found.best_iteration == int(np.argmin(losses)) + 1 and len(losses) == found.best_iteration + 2
    assert max(trained) < 50


def test_stored_params_keep_every_bit(spark, tmp_path):
    params = {"lower": {"learning_rate": 0.1 + 0.2, "max_depth": 7}, "upper": {}}
    store_params(spark, params, str(tmp_path / "p"))
    assert stored_params(spark, str(tmp_path / "p")) == params


def test_quantile_model_reloads_and_scores(spark, toy, tmp_path):
    model = QuantileBoosting(["a", "b"], "y", 0.9, n_estimators=4, learning_rate=0.5, colsample_bytree=0.5).fit(toy)
    row = model.evaluate(toy).first()
    model.save(spark, str(tmp_path / "m"))
    assert QuantileBoosting.load(spark, str(tmp_path / "m")).evaluate(toy).first() == row
    assert 0.8 < row.share_below <= 1


def test_quantile_search_prefers_the_better_setting(spark, toy):
    space = {"max_depth": ("int", 0, 4), "learning_rate": ("real", 0.5, 0.5)}
    drawn = [d["max_depth"] for d in draw(space, 3, seed=1)]
    assert len(set(drawn)) > 1
    best = tune_interval(toy, "ts", [], ["a", "b"], "y", space, n_iter=3, n_splits=2, n_estimators=2, seed=1)
    assert set(best) == {"lower", "median", "upper"} and best["median"]["max_depth"] == max(drawn)


def test_neighbours_as_a_model(spark, toy, tmp_path):
    rows = toy.withColumn("id", F.unix_micros(F.col("ts").cast("timestamp")))
    train, test = rows.where("ts < timestamp_ntz'2024-01-20'"), rows.where("ts >= timestamp_ntz'2024-01-20'")
    model = NeighbourForecaster(["a", "b"], "y", "id", k=3, weights="distance", p=1).fit(train)
    score = model.evaluate(test).first()
    assert score.rmse < 0.6
    model.save(spark, str(tmp_path / "m"))
    assert NeighbourForecaster.load(spark, str(tmp_path / "m")).evaluate(test).first().rmse == pytest.approx(score.rmse)
    found = search(train, "ts", [], lambda p: NeighbourForecaster(["a", "b"], "y", "id", **p), expand_grid({"k": [3, 200]}), n_splits=2)
    assert found.best_params == {"k": 3}


# --- registered queries without a SQL form -----------------------------------------------------


@pytest.fixture(scope="module")
def naive(features):
    return features.where("split = 'test'").select("ts", F.col("v").alias("y"), F.col("v_lag_7").alias("naive")).toPandas().set_index("ts").sort_index()


def _rmse(a, b):
    return float(np.sqrt(np.mean((np.asarray(a) - np.asarray(b)) ** 2)))


def _query(spark, name):
    return L.QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", ["pca_codes_forecast", "tune_older_refit_newer"])
def test_forecast_queries_beat_last_week(spark, naive, name):
    got = _query(spark, name).set_index("ts").sort_index()
    assert list(got.index) == list(naive.index) and np.allclose(got.y, naive.y)
    assert _rmse(got.prediction, got.y) < _rmse(naive.naive, naive.y)


def test_quantile_query(spark, naive):
    got = _query(spark, "quantile_gbt").set_index("ts").sort_index()
    assert list(got.index) == list(naive.index) and np.allclose(got.y, naive.y)
    assert np.mean((got.y >= got.lower) & (got.y <= got.upper)) > 0.9
    assert np.mean(got.lower) < np.mean(got["median"]) < np.mean(got.upper)


def test_batch_score_query(spark, features):
    got = _query(spark, "batch_score").set_index("ts").sort_index()
    want = features.select("ts", "v", "split").toPandas().set_index("ts").sort_index()
    assert list(got.index) == list(want.index) and np.allclose(got.y, want.v) and got.prediction.notna().all()
    old = (want.split == "train").to_numpy()
    assert _rmse(got.prediction[old], got.y[old]) < np.std(got.y[old])


def test_compression_queries(spark):
    rows, names = L._vector_columns(spark, SF)
    x = rows.orderBy("vec_id").select(*names).toPandas().to_numpy()
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    s = np.linalg.svd(z, compute_uv=False)
    codes = _query(spark, "pca_codes").sort_values("vec_id")[[f"code_{i}" for i in range(8)]].to_numpy()
    assert np.allclose(codes.var(axis=0), s[:8] ** 2 / len(x), rtol=1e-6)
    error = _query(spark, "pca_reconstruction_error").iloc[0]
    assert error.recon_mse == pytest.approx((s[8:] ** 2).sum() / z.size, rel=1e-6)


def test_search_queries(spark):
    grid = _query(spark, "grid_search_cv").sort_values("candidate")
    assert list(grid.params) == [str(p) for p in ({"kernel": "linear", "C": 0.1}, {"kernel": "linear", "C": 1.0}, {"kernel": "rbf", "C": 1.0, "gamma": 0.1})]
    assert (grid.cv_rmse >= grid.cv_mae).all() and (grid.cv_mae > 0).all()
    near = _query(spark, "knn_search_cv").sort_values("candidate")
    assert len(near) == 12 and (near.cv_rmse >= near.cv_mae).all()
    drawn = _query(spark, "random_search_cv").sort_values("candidate")
    assert list(drawn.columns) == ["candidate", "cv_pinball", "params"] and len(drawn) == 2 and (drawn.cv_pinball > 0).all()


def test_early_stop_query(spark):
    got = _query(spark, "gbt_early_stop").sort_values("iteration")
    assert got.best_iteration.nunique() == 1 and got.best_iteration.iloc[0] == int(got.val_loss.to_numpy().argmin()) + 1
    assert list(got.iteration) == list(range(1, len(got) + 1)) and got.train_loss.iloc[-1] < got.train_loss.iloc[0]
    assert len(got) in (20, got.best_iteration.iloc[0] + 5)


def test_panel_and_leaderboard_queries(spark):
    panel = _query(spark, "panel_forecast").iloc[0]
    assert panel.rmse > 0 and panel.rmse >= panel.mae and panel.r2 < 1 and 0 < panel.smape <= 200
    board = _query(spark, "ensemble_leaderboard").set_index("model")
    assert set(board.index) == {"forest", "boosted", "blend"} and board.weight_forest.between(0, 1).all()
    # A blend of two never does worse than the worse of the two.
    assert board.rmse["blend"] <= max(board.rmse["forest"], board.rmse["boosted"]) + 1e-9


def test_neighbours_visit_few_rows_in_8_dimensions(spark):
    """Even rows without any structure: a tenth of all pairs at most, and at most k rows per query and block go on."""
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(20_000, 8))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "y": 0.0, **{f"x{j}": x[:, j] for j in range(8)}}))
    names = [f"x{j}" for j in range(8)]
    asked = df.where("id % 10 = 0")
    index = NeighbourIndex(df, names, "id", "y")
    assert index.visited_pairs(asked, 5, exclude_self=True) < 0.1 * len(x) * 2_000
    got = index.neighbours(asked, 5, exclude_self=True).toPandas().groupby("id")["neighbour"].apply(set)
    for i in range(0, 20_000, 1_000):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert got[i] == set(np.argsort(d, kind="stable")[:5].tolist())


def test_vectors_without_structure_are_compared_by_blocks(spark):
    """64 even dimensions, where no bound leaves out a leaf: the exact neighbours, with copies, ties and vectors that are
    not finite, and no list of leaves per query.
    """
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3_000, 64)).astype(np.float32).astype(float)
    x[100:700] = x[100]
    x[5, 3], x[6, 0] = np.nan, np.inf
    df = spark.createDataFrame([(int(i), [float(v) for v in row], float(i % 7)) for i, row in enumerate(x)], "id long, x array<double>, y double")
    index = NeighbourIndex(df, "x", "id", "y", rows_per_chunk=700)
    near = index.neighbours(df, 5, exclude_self=True)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert index.sweeps and "leaves" not in plan and "CoGroup" in plan
    got = near.toPandas().sort_values(["id", "distance", "neighbour"])
    assert len(got) == 2_998 * 5 and not got["id"].isin([5, 6]).any() and not got["neighbour"].isin([5, 6]).any()
    found = {i: (g["neighbour"].tolist(), g["distance"].tolist()) for i, g in got.groupby("id")}
    for i in [0, 4, 7, 99, 100, 101, 399, 699, 700, *range(800, 3_000, 200)]:
        d = np.sqrt((np.abs(x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = np.argsort(d, kind="stable")[:5]
        assert found[i] == (want.tolist(), d[want].tolist())


@pytest.mark.parametrize("kind", ["offset", "copies", "tiny", "wide", "near", "max"])
@pytest.mark.parametrize("k", [1, 5, 700])
def test_products_of_blocks_lose_no_neighbour(kind, k):
    """Rounding of the products never decides: far from zero, equal, very small, mixed and very large numbers."""
    rng = np.random.default_rng(8)
    x = {
        "offset": lambda: rng.normal(size=(900, 8)) * 1e-3 + 1e9,
        "copies": lambda: np.repeat(rng.normal(size=(3, 16)), 300, axis=0),
        "tiny": lambda: rng.normal(size=(900, 5)) * 1e-200,
        "wide": lambda: rng.normal(size=(900, 5)) * 10.0 ** rng.integers(-30, 30, size=(900, 1)),
        "near": lambda: np.concatenate([rng.normal(size=(1, 32)) + 1e-6 * rng.normal(size=(800, 32)), rng.normal(size=(100, 32))]),
        "max": lambda: rng.choice([1.7e308, -1.7e308, 1.0], size=(900, 3)),
    }[kind]()
    ids = np.arange(len(x))
    with np.errstate(all="ignore"):
        d = distances(x, x, 2)
        np.fill_diagonal(d, np.inf)
        at, which, gap = best_of_block(x, ids, x, ids, k, exclude_self=True)
    want = {(i, int(j), d[i, j]) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:k] if np.isfinite(d[i, j])}
    assert set(zip(at.tolist(), which.tolist(), gap.tolist())) == want


def test_many_queries_of_one_place_are_dealt_out(spark):
    df = spark.range(3_000).select("id", (F.col("id") % 3).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    asked = spark.range(3_000).select((F.col("id") + 10_000).alias("id"), F.lit(1.0).alias("x"))
    near = NeighbourIndex(df, ["x"], "id", "y", rows_per_chunk=1_000).neighbours(asked, 2).toPandas()
    assert len(near) == 6_000 and set(near["neighbour"]) == {1, 4} and (near["distance"] == 0).all()


def test_rounds_are_those_of_one_long_fit(spark, toy, monkeypatch):
    """Each round is trained once, and losses and predictions are MLlib's own."""
    train, val = toy.where("ts < timestamp_ntz'2024-01-20'"), toy.where("ts >= timestamp_ntz'2024-01-20'")
    trained = []
    learner = SquaredBoosting._learner
    monkeypatch.setattr(SquaredBoosting, "_learner", lambda self, k: trained.append(k) or learner(self, k))
    make = lambda n: Forecaster(R.gradient_boosting(n, max_depth=2, learning_rate=0.2), ["a", "b"], "y", "standard")
    found = boost_with_early_stop(make, train, val, 7, 50)
    whole = make(7).fit(train)
    assert trained == list(range(7))
    losses = found.losses.orderBy("iteration").toPandas()
    for name, part in (("train_loss", train), ("val_loss", val)):
        np.testing.assert_allclose(losses[name], whole.regressor.evaluateEachIteration(whole.vectors(part), "squared"), rtol=1e-9)
    best = make(found.best_iteration).fit(train)
    a, b = (m.predict(val).orderBy("ts").toPandas()[PREDICTION] for m in (found.model, best))
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_boosted_model_survives_reload(spark, toy, tmp_path):
    make = lambda n: Forecaster(R.gradient_boosting(n), ["a", "b"], "y")
    model = boost_with_early_stop(make, toy.where("a < 1"), toy.where("a >= 1"), 3, 3).model
    model.save(spark, str(tmp_path / "m"))
    again = Forecaster.load(spark, str(tmp_path / "m"))
    assert again.evaluate(toy).first() == model.evaluate(toy).first()


def test_search_assembles_once_per_setting_of_the_stages(spark, toy, monkeypatch):
    made = []
    assembled = Forecaster.assembled
    monkeypatch.setattr(Forecaster, "assembled", lambda self, df: made.append(self.stage_settings()) or assembled(self, df))

    def make(p):
        expand = [R.FourierFeatures(gamma=p["gamma"], size=16)] if p["kernel"] == "rbf" else []
        return Forecaster(R.robust_linear(C=p["C"], max_iter=5), ["a", "b"], "y", expand=expand)

    grid = expand_grid([{"kernel": ["linear"], "C": [0.1, 1, 10]}, {"kernel": ["rbf"], "C": [0.1, 1, 10], "gamma": [0.5, 2.0]}])
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = search(toy, "ts", [], make, grid, n_splits=2, scores=("rmse",))
    assert len(made) == len(set(made)) == 3
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == cached
    apart = make(grid[4])
    folds = expanding_folds(toy, "ts", [], 2)
    scores = [apart.fit(folds.where(f"block < {i}")).evaluate(folds.where(f"block = {i}")).first()["rmse"] for i in (1, 2)]
    assert found.table.where("candidate = 4").first()["cv_rmse"] == pytest.approx(np.mean(scores))


SPACE_OF_TREES = {
    "max_depth": ("int", 3, 10), "learning_rate": ("log", 0.01, 0.3), "subsample": ("real", 0.6, 1.0), "min_child_weight": ("int", 1, 10), "gamma": ("real", 0.0, 5.0),
}


def test_draws_in_turn_beat_plain_draws():
    def loss(p):
        rate = np.log(p["learning_rate"] / 0.05)
        return (p["max_depth"] - 6) ** 2 / 10 + rate**2 + 4 * (p["subsample"] - 0.8) ** 2 + (p["gamma"] - 1) ** 2 / 5 + abs(p["min_child_weight"] - 3) / 10

    plain, in_turn = [], []
    for seed in range(20):
        plain.append(min(map(loss, draw(SPACE_OF_TREES, 50, seed))))
        draws = ParzenDraws(SPACE_OF_TREES, seed)
        for _ in range(50):
            p = draws.next()
            assert all(low <= p[n] <= high for n, (_, low, high) in SPACE_OF_TREES.items())
            draws.tell(p, loss(p))
        in_turn.append(min(s for _, s in draws.finished))
    assert np.median(in_turn) < 0.6 * np.median(plain)


def test_search_in_turn_reports_every_draw(spark, toy):
    make = lambda p: Forecaster(R.random_forest(n_estimators=2, max_depth=p["max_depth"]), ["a", "b"], "y")
    found = search_in_turn(toy, "ts", [], make, {"max_depth": ("int", 0, 5)}, n_iter=5, at_once=2, n_splits=2)
    rows = found.table.orderBy("candidate").collect()
    assert [r["candidate"] for r in rows] == list(range(5)) and found.best_score == pytest.approx(min(r["cv_rmse"] for r in rows))
    assert str(found.best_params) == min(rows, key=lambda r: r["cv_rmse"])["params"]


def _tube_objective(x, y, w, b, C, epsilon):
    return w @ w / 2 + C * np.maximum(0, np.abs(y - x @ w - b) - epsilon).sum()


def test_support_vectors_reach_the_optimum(spark):
    """Not above what a long dense subgradient descent finds, nor above any point near by (the problem is convex)."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, -1.0, 0.0] + 4 + rng.standard_t(2, 200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(5)
    C, epsilon = 0.5, 0.3
    model = Forecaster(V.support_vectors(C, epsilon), ["a", "b", "c"], "y").fit(df).regressor
    w, b = np.array(model.coefficients), model.intercept
    found = _tube_objective(x, y, w, b, C, epsilon)
    v, least = np.zeros(4), np.inf
    ones = np.column_stack([x, np.ones(200)])
    for k in range(20_000):
        r = y - ones @ v
        slope = -C * (np.sign(r) * (np.abs(r) > epsilon)) @ ones + np.append(v[:3], 0)
        least = min(least, _tube_objective(x, y, v[:3], v[3], C, epsilon))
        v = v - 0.05 / (1 + k) ** 0.6 * slope / 10
    assert found < least * 1.001
    for scale in (0.3, 0.03):
        for _ in range(200):
            d = rng.normal(size=4) * scale
            assert found < _tube_objective(x, y, w + d[:3], b + d[3], C, epsilon) * (1 + 1e-4)


def test_landmarks_give_the_kernel(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 3, (40, 2))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": np.sin(2 * x[:, 0]) + 0.1 * x[:, 1]}))
    model = Forecaster(V.support_vectors(50.0, 0.01), ["a", "b"], "y", expand=[V.NystromFeatures(gamma=0.7, size=100)]).fit(df)
    rows = model.vectors(df.orderBy("a")).select("_nystrom").collect()
    features = np.array([r["_nystrom"].toArray() for r in rows])
    ordered = x[np.argsort(x[:, 0])]
    kernel = np.exp(-0.7 * ((ordered[:, None] - ordered[None]) ** 2).sum(axis=2))
    np.testing.assert_allclose(features @ features.T, kernel, atol=1e-6)
    straight = Forecaster(V.support_vectors(50.0, 0.01), ["a", "b"], "y").fit(df).evaluate(df).first()["rmse"]
    rmse = model.evaluate(df).first()["rmse"]
    assert rmse < 0.2 * straight
    model.save(spark, str(tmp_path / "m"))
    assert Forecaster.load(spark, str(tmp_path / "m")).evaluate(df).first()["rmse"] == pytest.approx(rmse)


def test_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(V, "_FAN", 3)
    rows = spark.range(1_000).select(F.array(F.col("id").cast("double")).alias("x"), F.lit(2.0).alias("y")).repartition(20).persist()
    sums = V._summed(rows, lambda x, y: np.array([x[:, 0].sum(), x[:, 1].sum(), y.sum()]), 3)
    rows.unpersist()
    assert sums.tolist() == [499_500, 1_000, 2_000]
