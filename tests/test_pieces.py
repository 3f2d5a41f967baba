"""Cut series give the same results as plain windows, whatever the piece size."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import SF, at, hours
from pyspark.sql import Window, functions as F

from tidemill.operators import correlogram, features, fill, grid, pieces, profile, ranks
from tidemill.operators import buckets as B, clean
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.features import lag_and_rolling
from tidemill.operators.fill import interpolate_time
from tidemill.operators.filters import first_days, last_rows, skip_first
from tidemill.operators.grid import reindex, resample_month_mean
from tidemill.operators.split import expanding_folds, split_ratio, split_tail
from tidemill.session import scratch_path
from tidemill.sources.tables import materialise


@pytest.fixture(scope="module")
def panel(spark):
    """One key holds most rows; values have gaps."""
    rng = random.Random(7)
    rows = [
        (k, t, None if rng.random() < 0.3 else float(rng.randint(0, 1000)))
        for k, n in (("hot", 900), ("b", 120), ("c", 1))
        for t in hours(n)
    ]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("step", [3600, None])
@pytest.mark.parametrize("rows", [7, 100])
def test_lags_and_means_across_pieces(panel, step, rows):
    columns = {"lag": lambda w: F.lag("v", 24).over(w), "lead": lambda w: F.lead("v", 2).over(w), "mean": features.past_mean("v", 10)}
    got = B.over_rows(panel, ["k"], "ts", columns, 24, 2, step=step, rows_per_piece=rows)
    spec = Window.partitionBy("k").orderBy("ts")
    want = panel.select("*", *[f(spec).alias(n) for n, f in columns.items()])
    same(got, want)


def test_ordinals(panel):
    got = B.with_ordinal(panel, ["k"], "ts", width=5 * 3600 * 1_000_000)
    want = panel.withColumn("ordinal", F.row_number().over(Window.partitionBy("k").orderBy("ts")) - 1)
    same(got, want)


@pytest.mark.parametrize("rows", [3, 50, 8192])
def test_fill_across_pieces(panel, monkeypatch, rows):
    whole = fill.interpolate_time(panel, ["k"], "ts", ["v"], 3600, both_edges=True)
    middle = fill.fill_midpoint(panel, ["k"], "ts", ["v"], 3600)
    monkeypatch.setattr(fill, "ROWS_PER_FILL", rows)
    same(fill.interpolate_time(panel, ["k"], "ts", ["v"], 3600, both_edges=True), whole)
    same(fill.fill_midpoint(panel, ["k"], "ts", ["v"], 3600), middle)
    pdf = panel.where("k = 'hot'").orderBy("ts").toPandas().set_index("ts")
    expect = pdf["v"].interpolate(method="time", limit_direction="both").to_numpy()
    got = whole.where("k = 'hot'").orderBy("ts").toPandas()["v"].to_numpy()
    np.testing.assert_allclose(got, expect)


def test_no_nulls_left_after_two_sided_fill(panel):
    out = fill.interpolate_time(panel.where("k <> 'c'"), ["k"], "ts", ["v"], 3600, both_edges=True)
    assert out.where("v IS NULL").count() == 0 and out.count() == 1020


def test_extra_columns_ride_along(panel):
    wide = panel.withColumn("note", F.concat("k", F.lit("!")))
    out = fill.interpolate_time(wide, ["k"], "ts", ["v"], 3600)
    assert out.columns == wide.columns and out.where("note <> concat(k, '!')").count() == 0


def test_fill_runs_on_one_shuffle_of_its_input(spark, panel):
    stored = materialise(panel, scratch_path(spark, "panel"))
    out = fill.interpolate_time(stored, ["k"], "ts", ["v"], 3600)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_grid_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(grid, "_POINTS_PER_BLOCK", 7)
    df = spark.createDataFrame([("a", at("2024-01-01")), ("a", at("2024-01-09 05:00"))], "k string, ts timestamp_ntz")
    times = [r.ts for r in grid.regular_grid(df, ["k"], "ts", 3600).orderBy("ts").collect()]
    assert times == hours(24 * 8 + 6)


def test_steps_with_repeats_and_gaps(spark):
    times = [0, 0, 0, 1, 2, 2, 9]
    rows = [("a", at("2024-01-01") + dt.timedelta(hours=h)) for h in times]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    hist = {r.step_seconds: r.n_rows for r in clean.step_histogram(df, ["k"], "ts").collect()}
    assert hist == {0.0: 3, 3600.0: 2, 7 * 3600.0: 1}
    odd = clean.discontinuities(df, ["k"], "ts", expected=3600).collect()
    found = sorted((r.ts.hour, -1 if r.step_seconds is None else r.step_seconds, r.n_rows) for r in odd)
    assert found == [(0, -1, 1), (0, 0, 2), (2, 0, 1), (9, 25200, 1)]


def test_piece_width_narrows_for_dense_rows(spark):
    rows = [("a", at("2024-01-01") + dt.timedelta(seconds=i)) for i in range(300)] + [("a", at("2020-01-01"))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    assert B.piece_width(df, ["k"], "ts", max_rows=100) == 60 * 1_000_000
    assert B.piece_width(df, ["k"], "ts", max_rows=1_000) == 365 * 86_400 * 1_000_000


def test_rank_search(spark):
    rng = random.Random(3)
    rows = [(at("2024-01-01") + dt.timedelta(seconds=int(rng.expovariate(1 / 5000.0))), i) for i in range(2_000)]
    rows += [(at("2024-01-01 06:00"), 10_000 + i) for i in range(1_000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, i long")
    ordered = sorted(rows)
    wanted = [0, 1, 1234, 2000, 2500, 2998, 2999]
    for max_rows in (50, 100_000):
        found = ranks.rows_at(df, "ts", ["i"], wanted, max_rows=max_rows)
        assert {r: (found[r]["ts"], found[r]["i"]) for r in wanted} == {r: ordered[r] for r in wanted}
    tail = split_tail(df, "ts", ["i"], 700).where("split = 'test'").collect()
    assert sorted((r.ts, r.i) for r in tail) == ordered[-700:]
    assert split_ratio(df, "ts", ["i"], 0.1).where("split = 'test'").count() == 300
    assert split_tail(df, "ts", ["i"], 0).where("split = 'test'").count() == 0


def test_quantiles_of_large_groups(spark):
    """A hot group with heavy ties and a long tail next to small groups, on the sketch route."""
    rng = np.random.default_rng(5)
    data = {"hot": np.concatenate([np.full(30_000, 7.0), rng.lognormal(3, 2, 60_000).round(2)]), "small": rng.normal(size=37), "one": np.array([4.0])}
    import pandas as pd

    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in data.items()])
    df = spark.createDataFrame(pdf).repartition(8)
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.977, "f": 0.99, "g": 1.0}
    for got in exact_quantiles(df, ["k"], "v", probs, direct_rows=100).collect():
        np.testing.assert_allclose([got[n] for n in probs], np.quantile(data[got["k"]], list(probs.values())), rtol=1e-12)
    row = exact_quantiles(df.where("k = 'hot'"), [], "v", probs, direct_rows=100).first()
    np.testing.assert_allclose([row[n] for n in probs], np.quantile(data["hot"], list(probs.values())), rtol=1e-12)


def test_autocorrelation_refuses_repeated_steps(spark):
    rows = spark.range(50).selectExpr("timestamp_seconds(3600 * id) AS ts", "sin(id) AS v")
    without_time = rows.unionByName(spark.sql("SELECT CAST(NULL AS timestamp) AS ts, 1000d AS v"))
    acf = [correlogram.autocorrelation(d, [], "ts", "v", 2, 3600).orderBy("lag").collect() for d in (rows, without_time)]
    assert acf[0] == acf[1]
    with pytest.raises(Exception, match="two rows of a series on one step"):
        correlogram.autocorrelation(rows.unionByName(rows.limit(1)), [], "ts", "v", 2, 3600).collect()


def test_autocorrelation_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(correlogram, "ROWS_PER_PIECE", 64)
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=500))
    rows = [(t, float(v)) for t, v in zip(hours(500), x)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    acf = correlogram.autocorrelation(df, [], "ts", "v", 6, 3600)
    got = acf.orderBy("lag").collect()
    c = x - x.mean()
    want = [float(c[: len(c) - k] @ c[k:] / (c @ c)) for k in range(7)]
    np.testing.assert_allclose([r.acf for r in got], want)
    band = correlogram.Z_95 * np.sqrt((1 + 2 * sum(w**2 for w in want[1:3])) / 500)
    assert got[3].upper - got[3].acf == pytest.approx(band)
    # Partial autocorrelation solves the Yule-Walker equations of each order.
    pacf = [r.pacf for r in correlogram.partial_autocorrelation(acf, []).orderBy("lag").collect()]
    for k in range(1, 7):
        toeplitz = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(toeplitz, want[1 : k + 1])[-1])


@pytest.fixture
def with_nulls(spark):
    """5 rows of series `a`, 5 of a NULL series, and a row of each without a time."""
    rows = [(k, at(f"2024-01-01 0{h}:00"), float(h)) for k in ("a", None) for h in range(5)]
    return spark.createDataFrame(rows + [("a", None, 9.0), (None, None, 9.0)], "k string, ts timestamp_ntz, v double")


def test_null_keys_and_times_stay(with_nulls):
    timed = with_nulls.where("ts IS NOT NULL")
    assert last_rows(with_nulls, ["k"], "ts", 1000).count() == last_rows(with_nulls, ["k"], "ts", 1001).count() == 12
    for n in (3, 1001):
        assert {(r["k"], r["v"]) for r in last_rows(timed, ["k"], "ts", n).collect()} == {(k, float(v)) for k in ("a", None) for v in range(5) if n > 5 or v >= 5 - n}
    assert interpolate_time(with_nulls, ["k"], "ts", ["v"], 3600).count() == 12
    assert lag_and_rolling(with_nulls, ["k"], "ts", "v", lags=[1], windows=[2]).count() == 12
    lags = lag_and_rolling(timed, ["k"], "ts", "v", lags=[1], windows=[2]).where("k IS NULL").orderBy("ts")
    assert [r["v_lag_1"] for r in lags.collect()] == [None, 0.0, 1.0, 2.0, 3.0]
    assert reindex(timed, ["k"], "ts", 3600).where("v IS NULL").count() == 0
    assert resample_month_mean(timed, ["k"], "ts", ["v"]).where("v = 2.0").count() == 2


def test_skip_first_keeps_rows_without_a_time(with_nulls):
    kept = skip_first(with_nulls, ["k"], "ts", 1)
    assert kept.count() == 10 and kept.where("v = 0").count() == 0 and kept.where("ts IS NULL").count() == 2
    assert skip_first(with_nulls, [], "ts", 4).count() == 4
    assert skip_first(with_nulls.where("ts IS NULL"), ["k"], "ts", 1).count() == 2


@pytest.mark.parametrize("n_tail", [1, 9, 10, 11, 12])
def test_splits_with_null_times(with_nulls, n_tail):
    got = split_tail(with_nulls, "ts", ["k", "v"], n_tail)
    assert got.where("split = 'test'").count() == n_tail
    assert got.where("split = 'train' AND ts IS NOT NULL").count() == max(0, 10 - n_tail)


def test_folds_with_null_times(with_nulls):
    blocks = {r["block"]: r["count"] for r in expanding_folds(with_nulls, "ts", ["k"], 2).groupBy("block").count().collect()}
    assert blocks == {0: 4, 1: 4, 2: 4}


def test_quantile_routes_agree_to_the_last_bit(spark):
    df = spark.range(5_000).select((F.col("id") % 3).alias("k"), (F.rand(3) * 1e6 * F.rand(4)).alias("v")).cache()
    probs = {"a": 0.1, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1 / 3}
    direct = exact_quantiles(df, ["k"], "v", probs).orderBy("k").collect()
    assert direct == exact_quantiles(df, ["k"], "v", probs, direct_rows=10).orderBy("k").collect()


def test_first_days_bounds_reach_the_scan(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = first_days(events, "ts")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_ranks_inside_one_hot_instant(spark):
    """Ranges of the tie, with a value that alone fills several ranges, and NULLs."""
    ties = [None] * 40 + [7] * 900 + list(range(1000))
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), t) for t in ties], "ts timestamp_ntz, tie int").repartition(7)
    order = sorted(ties, key=lambda t: (t is not None, t or 0))
    want = [0, 39, 40, 47, 500, 946, 947, 948, 1500, 1939]
    found = ranks.rows_at(df, "ts", ["tie"], want, max_rows=50)
    assert {r: found[r]["tie"] for r in want} == {r: order[r] for r in want}
    assert ranks.rows_at(df, "ts", [], [3, 1000], max_rows=50)[1000]["ts"] == dt.datetime(2024, 1, 1)


def test_ordinals_of_a_burst(spark):
    """Most rows stand on one instant, many of them equal in time and tie: no piece exceeds its share."""
    burst = dt.datetime(2024, 1, 1)
    rows = [("a", burst, i % 50) for i in range(4000)] + [(None, burst + dt.timedelta(hours=i % 9), i) for i in range(300)] + [("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, tie int").repartition(5)
    assert B.piece_width(df, ["k"], "ts", max_rows=200) is None
    got = B.with_ordinal(df, ["k"], "ts", ["tie"], most_rows=200)
    assert got.count() == len(rows)
    for k in ("a", None):
        own = sorted(((t is not None, t or burst, tie) for key, t, tie in rows if key == k))
        found = got.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("ordinal").collect()
        assert [r["ordinal"] for r in found] == list(range(len(own)))
        assert [(r["ts"] is not None, r["ts"] or burst, r["tie"]) for r in found] == own
    pieces = B.cut_by_ranges(df, ["k", "ts", "tie"], 200).groupBy(B.PIECE).count()
    assert pieces.agg(F.max("count")).first()[0] <= 600


def _gappy(spark):
    """Series with short gaps, a gap of many pieces, one row, a NULL key, values that are missing, and rows without a time."""
    rng = random.Random(11)
    rows = []
    for k, times in (("a", [0, 1, 2, 5, 6, 400, 401, 403]), ("b", [7]), (None, [3, 4, 90]), ("c", list(range(0, 200, 3)))):
        rows += [(k, hours(500)[h], None if rng.random() < 0.3 else float(rng.randint(0, 99)), f"{k}{h}") for h in times]
    rows.append(("a", None, 1.0, "x"))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, note string").repartition(3)


@pytest.mark.parametrize("steps, group", [(7, 3), (131_072, 1_024)])
def test_grid_inside_pieces_is_the_joined_grid(spark, monkeypatch, steps, group):
    monkeypatch.setattr(pieces, "PIECE_STEPS", steps)
    monkeypatch.setattr(pieces, "GROUP_PIECES", group)
    monkeypatch.setattr(pieces, "_BLOCK_STEPS", 5)
    df = _gappy(spark)
    for keys, rows in ((["k"], df), ([], df.where("k = 'a'").drop("k"))):
        joined = reindex(rows.where("ts IS NOT NULL"), keys, "ts", 3600)
        same(reindex(rows, keys, "ts", 3600, aligned=True), joined)
        for both in (False, True):
            want = interpolate_time(joined, keys, "ts", ["v"], 3600, both_edges=both, flag="filled")
            same(interpolate_time(rows, keys, "ts", ["v"], 3600, both_edges=both, flag="filled", grid=True), want)
        same(fill.fill_midpoint(rows, keys, "ts", ["v"], 3600, grid=True), fill.fill_midpoint(joined, keys, "ts", ["v"], 3600))


def test_grid_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, ts timestamp_ntz, v double")
    assert interpolate_time(none, ["k"], "ts", ["v"], 3600, grid=True).count() == 0
    assert reindex(none, [], "ts", 3600, aligned=True).columns == ["ts", "k", "v"]


def test_long_gaps_are_dealt_by_their_steps(spark, monkeypatch):
    monkeypatch.setattr(pieces, "_TASK_STEPS", 1_000)
    monkeypatch.setattr(pieces, "_BLOCK_STEPS", 100)
    monkeypatch.setattr(pieces, "PIECE_STEPS", 500)
    rows = [(at("2024-01-01"), 1.0), (at("2025-01-01"), 5.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = interpolate_time(df, [], "ts", ["v"], 3600, grid=True)
    assert out.count() == 366 * 24 + 1 and out.where("v IS NULL").count() == 0
    assert out.agg(F.avg("v")).first()[0] == pytest.approx(3.0)
    assert out.where("ts > timestamp_ntz'2024-01-01' AND ts < timestamp_ntz'2025-01-01'").select(F.spark_partition_id()).distinct().count() >= 4


def _plan(name, spark):
    from tidemill.catalog import all_queries

    return all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, most", [("clean_panel", 6), ("clean_national", 4), ("build_slot_features", 4), ("regular_grid", 2), ("resample_hour_mean", 2)]
)
def test_plans_read_little_and_never_one_partition(spark, name, most):
    """The final plan reads stored rows and the ends of their pieces; the sources were read once before."""
    plan = _plan(name, spark)
    assert 0 < plan.count("FileScan parquet") <= most
    assert "SinglePartition" not in plan


def test_positions_read_the_table_twice_with_pushed_bounds(spark, tmp_path):
    """One pass counts days, one reads the days that hold a wanted position."""
    rng = random.Random(5)
    rows = [(at("2024-01-01") + dt.timedelta(seconds=rng.randint(0, 40 * 86_400)), i) for i in range(3_000)] + [(None, -1), (None, -2)]
    spark.createDataFrame(rows, "ts timestamp_ntz, i long").repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = ranks.Positions(df, "ts", ["i"])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or at("2024-01-01"), r[1]))
    wanted = [0, 1, 2, 1500, 3001]
    for most in (100_000, 20):
        got = found.rows_at(wanted, most)
        assert {r: (got[r]["ts"], got[r]["i"]) for r in wanted} == {r: ordered[r] for r in wanted}
    plan = found._of_days([19_730, None])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(ts" in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize("order", [["i"], ["b", "d", "i"], ["t", "x", "i"], ["big", "x", "i"], ["day", "i % 3", "i"], ["name", "i"]])
def test_keep_first_by_packed_order(spark, order):
    """NULLs come first in the order; wide ranges and fractions are keys of their own; text takes the sorting route."""
    rng = random.Random(9)
    one = lambda x: None if rng.random() < 0.2 else x
    rows = [
        (one(rng.choice("ab")), i, one(rng.random() < 0.5), one(round(rng.random(), 1)), one(at("2024-01-01") + dt.timedelta(seconds=rng.randint(0, 9))),
         one(rng.choice([-(2**63), 2**63 - 1, 0])), one(dt.date(2024, 1, rng.randint(1, 9))), rng.choice([1.5, -2.5, None]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "k string, i long, b boolean, d double, t timestamp_ntz, big long, day date, x double").repartition(6)
    if "name" in order:
        df = df.withColumn("name", F.concat(F.lit("n"), (F.col("i") % 7).cast("string")))
    order = [F.expr(c) if " " in c else c for c in order]
    got = clean.dedup_keep_first(df, ["k"], order)
    rank = F.row_number().over(Window.partitionBy("k").orderBy(*[F.col(c).asc_nulls_first() if isinstance(c, str) else c.asc_nulls_first() for c in order]))
    want = df.withColumn("rank", rank).where("rank = 1").drop("rank")
    assert got.count() == 3
    same(got, want)
    assert ("SortAggregate" in got._jdf.queryExecution().executedPlan().toString()) == ("name" in df.columns)
    assert clean.dedup_keep_first(df.limit(0), ["k"], order).count() == 0


@pytest.mark.parametrize("name", ["dedup_keep_first", "clean_panel", "clean_weather"])
def test_keep_first_hashes(spark, name):
    assert "SortAggregate" not in _plan(name, spark)


@pytest.mark.parametrize("words", [1, 2])
def test_keep_first_carries_only_its_sort_key(spark, words):
    """Days, dates, flags, cents and wide ids come back from the sort key: no column is shuffled beside it, in few exchanges."""
    rng = random.Random(13)
    one = lambda x: None if rng.random() < 0.1 else x
    wide = 60_000_000 if words == 1 else 2**60
    rows = [
        (rng.randint(0, 40), one(at("1969-06-01") + dt.timedelta(days=rng.randint(0, 900))), one(rng.randint(-wide, wide)), one(rng.randint(0, wide)),
         one(rng.randint(-10**7, 10**7) / 100), one(float(rng.randint(1, 50))), one(rng.randint(0, 10) / 100), one(dt.date(1970, 1, rng.randint(1, 9))), one(rng.random() < 0.5))
        for _ in range(600)
    ]
    names = ["ts", "p", "s", "price", "quantity", "discount", "day", "flag"]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, p long, s long, price double, quantity double, discount double, day date, flag boolean").repartition(5)
    for one_df in (df, df.withColumn("ts", (F.col("ts") + F.expr("interval '0.000001' second")).cast("timestamp"))):
        got = clean.dedup_keep_first(one_df, ["k"], names)
        rank = F.row_number().over(Window.partitionBy("k").orderBy(*names))
        same(got, one_df.withColumn("rank", rank).where("rank = 1").drop("rank"))
        assert got.dtypes == one_df.dtypes
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") == (words if one_df is df else 2) and not any(f"min_by({c}" in plan for c in names), plan


def test_keep_first_keeps_negative_zero(spark):
    df = spark.createDataFrame([(1, -0.0, 2), (1, 0.0, 3), (2, 0.0, 1)], "k long, d double, i long")
    assert sorted(str(r) for r in clean.dedup_keep_first(df, ["k"], ["i", "d"]).collect()) == ["Row(k=1, d=-0.0, i=2)", "Row(k=2, d=0.0, i=1)"]


def test_rows_without_a_time_stay_on_the_step_route(with_nulls):
    out = lag_and_rolling(with_nulls, ["k"], "ts", "v", lags=[1], windows=[2], step=3600)
    assert out.count() == 12
    assert [r["v_lag_1"] for r in out.where("ts IS NULL").collect()] == [None, None]
    assert [r["v_lag_1"] for r in out.where("k IS NULL AND ts IS NOT NULL").orderBy("ts").collect()] == [None, 0.0, 1.0, 2.0, 3.0]


def test_correlations_of_a_wide_table(spark):
    """Columns with NULLs, a constant one, an empty one, NaN, a large mean; as the pairwise aggregate has them."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 6))
    names = [f"v{i}" for i in range(30)]
    values = base @ rng.normal(size=(6, 30)) + rng.normal(size=(300, 30))
    values[:, 1] += 1e9
    data = {n: [None if rng.random() < 0.1 else float(v) for v in values[:, i]] for i, n in enumerate(names)}
    data["v2"], data["v3"] = [7.0] * 300, [None] * 300
    rows = list(zip(*data.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    df = df.withColumn("v4", F.when(F.col("v0").isNull(), float("nan")).otherwise(F.col("v4")))
    got = {(r.col_a, r.col_b): r["corr"] for r in profile.corr_matrix(df, names).collect()}
    assert len(got) == 900
    few = ["v0", "v1", "v2", "v3", "v4", "v29"]
    for r in profile.corr_matrix(df, few).collect():
        other = got[r.col_a, r.col_b]
        assert other == pytest.approx(r["corr"], abs=1e-6, nan_ok=True) if r["corr"] is not None else other is None, (r, other)


def test_correlations_of_500_columns_in_one_pass(spark):
    df = spark.range(2_000).select(*[F.sin(F.col("id") * (i + 1)).alias(f"v{i}") for i in range(500)])
    out = profile.corr_matrix(df, df.columns)
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (0, 2000") == 1
    assert out.count() == 250_000 and out.where("col_a = col_b AND abs(corr - 1) > 1e-9").count() == 0


def test_autocorrelation_of_many_lags(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=12_000))
    df = spark.createDataFrame([(i * 3600, float(v)) for i, v in enumerate(x)], "s long, v double").select(F.timestamp_seconds("s").alias("ts"), "v")
    got = {r["lag"]: r["acf"] for r in correlogram.autocorrelation(df, [], "ts", "v", 10_000, 3600).collect()}
    c = x - x.mean()
    for k in (0, 1, 999, 9_999, 10_000):
        assert got[k] == pytest.approx(float(c[: len(c) - k] @ c[k:] / (c @ c)), abs=1e-9)
