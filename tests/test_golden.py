"""Fixed input/output vectors for every null and edge rule."""

import datetime as dt
import math

import pytest
from conftest import at, hours, values
from pyspark.sql import functions as F

from tidemill.functions import calendar as C, numeric as N
from tidemill.functions.timecols import from_seconds, minus_years, parse_day, slot_timestamp
from tidemill.operators import features, fill, filters, grid, metrics as M, profile as P, scale, split
from tidemill.operators.clean import dedup_keep_first, step_histogram, union_by_name
from tidemill.operators.quantiles import exact_quantiles
from tidemill.plans.national import clean_slots, stack_sources

HOUR = 3600
GAPPY = [None, 1.0, None, None, 4.0, None, None]


def test_time_fill_forward(hourly):
    out = fill.interpolate_time(hourly({"a": GAPPY}), ["k"], "ts", ["v"], HOUR)
    assert values(out) == [None, 1, 2, 3, 4, 4, 4]


def test_time_fill_both_edges(hourly):
    out = fill.interpolate_time(hourly({"a": GAPPY}), ["k"], "ts", ["v"], HOUR, both_edges=True)
    assert values(out) == [1, 1, 2, 3, 4, 4, 4]


def test_midpoint_fill(hourly):
    assert values(fill.fill_midpoint(hourly({"a": GAPPY}), ["k"], "ts", ["v"], HOUR)) == [None, 1, 2.5, 2.5, 4, None, None]


def test_time_fill_uneven_steps(spark):
    rows = [("a", at("2024-01-01 00:00"), 10.0), ("a", at("2024-01-01 00:30"), None), ("a", at("2024-01-01 02:00"), 40.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    assert values(fill.interpolate_time(df, ["k"], "ts", ["v"], 1800)) == [10, 17.5, 40]


@pytest.mark.parametrize("step", [HOUR, None])
def test_neighbour_mean(hourly, step):
    df = hourly({"a": [1.0, None, 3.0, None, None, 6.0]})
    assert values(fill.fill_neighbour_mean(df, ["k"], "ts", ["v"], step)) == [1, 2, 3, None, None, 6]


def test_flag_is_taken_before_filling(hourly):
    out = fill.interpolate_time(hourly({"a": GAPPY}), ["k"], "ts", ["v"], HOUR, flag="filled")
    assert values(out, "filled") == [1, 0, 1, 1, 0, 1, 1]


def test_past_rolling_mean(hourly):
    out = features.lag_and_rolling(hourly({"a": [1.0, 2.0, None, 4.0, 5.0]}), ["k"], "ts", "v", (), (2,), HOUR)
    assert values(out, "v_mean_2") == [None, None, 1.5, None, None]


def test_row_sum_and_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, None), (1.0, 0.0), (0.0, 0.0)], "a double, b double")
    out = df.select(N.row_sum(["a", "b"]).alias("s"), N.safe_ratio("a", "b").alias("r")).collect()
    assert [r.s for r in out] == [3, 0, 1, 0]
    assert [r.r for r in out] == [0.5, None, None, None]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(N.round_half_even("x")).collect()] == [0, 2, 2]


def test_day_resample_keeps_empty_days(spark):
    rows = [("a", at("2024-01-01 05:00"), 1.0), ("a", at("2024-01-03 07:00"), 3.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    assert values(grid.resample_mean(df, ["k"], "ts", ["v"], 86_400)) == [1, None, 3]


def test_month_resample_labels_month_end(spark):
    rows = [(at("2024-01-05 05:00"), 1.0), (at("2024-03-03 07:00"), 3.0)]
    out = grid.resample_month_mean(spark.createDataFrame(rows, "ts timestamp_ntz, v double"), [], "ts", ["v"])
    assert [tuple(r) for r in out.orderBy("ts").collect()] == [
        (at("2024-01-31"), 1.0), (at("2024-02-29"), None), (at("2024-03-31"), 3.0)
    ]


def test_year_cutoff_keeps_clock(spark):
    df = spark.createDataFrame([(at("2016-02-29 13:30"),)], "ts timestamp_ntz")
    assert df.select(minus_years("ts", 1)).first()[0] == at("2015-02-28 13:30")
    rows = [(at("2015-02-28 13:00"),), (at("2015-02-28 13:30"),), (at("2016-02-29 13:30"),)]
    out = split.split_years(spark.createDataFrame(rows, "ts timestamp_ntz"), "ts", 1).orderBy("ts").collect()
    assert [r.split for r in out] == ["train", "test", "test"]


def test_quartiles_interpolate(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    for direct_rows in (10, 0):
        assert exact_quantiles(df, [], "v", {"q": 0.25}, direct_rows).first()["q"] == 1.75


def test_correlation_ignores_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 6.0), (4.0, 9.0)], "x double, y double")
    found = {(r.col_a, r.col_b): r["corr"] for r in P.corr_matrix(df, ["x", "y"]).collect()}
    assert found["x", "y"] == pytest.approx(0.9986254289)
    assert len(found) == 4 and found["x", "y"] == found["y", "x"]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    z = scale.fit_scaler(df, ["x", "c"]).transform(df).orderBy("x").collect()
    assert [r.x for r in z] == pytest.approx([-1.2247448714, 0, 1.2247448714])
    assert [r.c for r in z] == [0, 0, 0]
    m = scale.fit_scaler(df, ["x", "c"], "minmax").transform(df).orderBy("x").collect()
    assert [(r.x, r.c) for r in m] == [(0, 0), (0.5, 0), (1, 0)]
    assert scale.fit_scaler(df, ["x"], "none").params == {}


def test_scaler_inverse_and_reload(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "x double")
    scaler = scale.fit_scaler(df, ["x"], "divide", factor=2.0)
    scaler.save(spark, str(tmp_path / "s"))
    again = scale.Scaler.load(spark, str(tmp_path / "s"))
    assert again == scaler
    back = again.inverse(again.transform(df), {"x": "x"})
    assert sorted(r.x for r in back.collect()) == [1, 2, 6]


def test_expanding_folds(spark):
    rows = [(t, i) for i, t in enumerate(hours(20))]
    df = split.expanding_folds(spark.createDataFrame(rows, "ts timestamp_ntz, i int"), "ts", ["i"], 5)
    blocks = [r.block for r in df.orderBy("i").collect()]
    # Train ends at row 4; test rows are 5-7, 8-10, 11-13, 14-16, 17-19.
    assert blocks == [0] * 5 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3 + [5] * 3


def test_cycles(spark):
    df = spark.createDataFrame([(6, 3, 1)], "hour int, weekday int, month int")
    row = C.with_cycles(df).first()
    assert (row.hour_sin, row.hour_cos, row.month_sin) == (1, 0, 0)
    assert row.weekday_sin == pytest.approx(0.4338837391)


def test_point_scores(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (400.0, 400.0)], "y double, p double")
    row = M.point_metrics(df, "y", "p", scores=("rmse", "mae", "mape", "sd", "r2", "smape")).first()
    assert row.rmse == pytest.approx(8.1649658093) and row.mae == pytest.approx(6.6666666667)
    assert row.mape == pytest.approx(5) and row.sd == pytest.approx(8.1649658093)
    assert row.r2 == pytest.approx(0.9957142857) and row.smape == pytest.approx(4.8840048840)
    loss = df.agg(M.pinball("y", "p", 0.01).alias("a"), M.pinball("y", "p", 0.99).alias("b"), M.pinball("y", "p", 0.5).alias("c")).first()
    assert loss.a == pytest.approx(10 / 3) and loss.b == pytest.approx(10 / 3)
    assert loss.c == pytest.approx(row.mae / 2)


def test_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0)], "y double, p double")
    row = M.point_metrics(df, "y", "p", scores=("mape", "smape")).first()
    assert row.mape == 50 and row.n_zero_actual == 1
    assert row.smape == pytest.approx((0 + 2 / 3) / 2 * 100)


def test_interval_scores_count_closed_bounds(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, 3.0), (4.0, 1.0, 2.0, 3.0)], "y double, l double, m double, u double")
    row = M.interval_metrics(df, "y", "l", "m", "u").first()
    assert row.picp == 50 and row.mpiw == 2


@pytest.fixture
def clock_change(spark):
    """A 46-slot day, a 50-slot day and the day after it."""
    days = [("26-Mar-2017", 46), ("27-Mar-2017", 48)], [("30-Oct-2016", 50), ("31-Oct-2016", 48)]
    schema = "day string, slot int, load double"

    def build(group):
        return spark.createDataFrame([(d, s, float(s)) for d, n in group for s in range(1, n + 1)], schema)

    return build(days[0]), build(days[1])


def test_clock_change_keeps_first_in_source_order(clock_change):
    _, autumn = clock_change
    stacked = stack_sources([autumn], "day", "slot", "ts")
    kept = dedup_keep_first(stacked, ["ts"], ["_source", "day", "slot"]).where(F.hour("ts") == 0).where(F.dayofmonth("ts") == 31)
    assert sorted((r.ts.minute, r.slot) for r in kept.collect()) == [(0, 49), (30, 50)]
    steps = step_histogram(stacked, [], "ts", ["_source", "day", "slot"], F.struct("_source", "day"))
    assert {r.step_seconds: r.n_rows for r in steps.collect()} == {1800.0: 96, -1800.0: 1}


def test_clock_change_cleaned(clock_change):
    spring, _ = clock_change
    out = clean_slots([spring], "day", "slot", time="ts").orderBy("ts").collect()
    assert len(out) == 96
    assert [r.slot for r in out if r.is_interpolated] == [31, 16]
    assert len({b.ts - a.ts for a, b in zip(out, out[1:])}) == 1


def test_uneven_union(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    out = union_by_name([a, b]).withColumn("flag", N.any_null(["x", "y"])).orderBy("x").collect()
    assert [tuple(r) for r in out] == [(1, 2, 0), (3, None, 1)]


def test_dates_and_slots(spark):
    df = spark.createDataFrame([("7-Jan-2016", 50), ("07-JAN-2016", 1), ("nonsense", 1)], "d string, s int")
    out = df.select(parse_day("d").alias("day"), "s").withColumn("ts", slot_timestamp("day", "s")).collect()
    assert [r.ts for r in out] == [at("2016-01-08 00:30"), at("2016-01-07 00:00"), None]
    assert spark.range(1).select(from_seconds(F.lit(1_451_606_400))).first()[0] == at("2016-01-01")


def test_first_and_last_rows(hourly):
    df = hourly({"a": [1.0, 2, 3, 4], "b": [5.0, 6, 7, 8]})
    assert values(filters.skip_first(df, ["k"], "ts", 3)) == [4, 8]
    assert values(filters.skip_first(df, [], "ts", 3)) == [4, 8]
    assert values(filters.last_rows(df, ["k"], "ts", 2)) == [3, 4, 7, 8]


def test_mask_and_complement_cover_all_rows(hourly):
    df = hourly({"a": [1.0, None, 3.0]})
    inside, outside = filters.split_by_mask(df, F.col("v") > 2)
    assert (inside.count(), outside.count()) == (1, 2)


def test_day_range_covers_the_last_day(spark):
    rows = [(at("2024-01-01 00:00"),), (at("2024-01-02 23:59"),), (at("2024-01-03 00:00"),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    assert filters.day_range(df, "ts", F.lit("2024-01-01"), F.lit("2024-01-02")).count() == 2


def test_one_hot_keeps_all_levels(spark):
    df = spark.createDataFrame([("fog",), ("rain",), (None,)], "icon string")
    out = N.one_hot(df, "icon").collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 1), (0, 0)]


def test_sequences_put_the_newest_lag_first(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0, 2.0, 5.0)], "id int, v_lag_10 double, v_lag_2 double, hour double, v double")
    row = features.make_sequences(df, ["id"], ["v_lag_10", "hour", "v_lag_2"], "v").first()
    assert list(row.sequence) == [1.0, 10.0] and list(row.static) == [2.0] and row.v == 5
