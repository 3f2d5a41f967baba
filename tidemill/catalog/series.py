"""Queries: grids, steps, lags, fills, resampling and whole cleaning and feature plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import inputs as I
from tidemill.catalog.registry import registry
from tidemill.functions.timecols import DAY, HOUR, epoch_seconds
from tidemill.operators import clean, features, fill, grid
from tidemill.plans.national import build_features, clean_slots, encode_features, stack_sources
from tidemill.plans.panel import clean_panel, clean_weather, panel_features, weather_lags

QUERIES, ORACLES, query = registry()
_TYPE = ["event_type"]


@query(f"WITH {I.HOURLY_GRID} SELECT event_type, ts, v FROM hgrid")
def regular_grid(spark, sf_dir):
    return I.hourly_grid(spark, sf_dir)


_STEPS = "steps AS (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY event_type ORDER BY ts), ts)::DOUBLE AS step_seconds FROM hourly)"


@query(
    f"WITH {I.HOURLY}, {_STEPS} SELECT event_type, step_seconds, count(*) AS n_rows FROM steps WHERE step_seconds IS NOT NULL GROUP BY 1, 2"
)
def gap_histogram(spark, sf_dir):
    return clean.step_histogram(I.hourly(spark, sf_dir), _TYPE, "ts")


@query(
    "WITH s AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY date_trunc('day', ts), event_type, ts, event_id)) AS d FROM events) "
    "SELECT floor(d / 1000000)::BIGINT AS whole_seconds, count(*) AS n_rows FROM s WHERE d IS NOT NULL GROUP BY 1"
)
def gap_histogram_source_order(spark, sf_dir):
    """Rows as a day-by-day, type-by-type file would hold them: steps go back as well as forward."""
    ev = I.table(spark, sf_dir, "events").select("ts", "event_type", "event_id")
    day = F.floor(epoch_seconds("ts") / DAY)
    steps = clean.time_steps(ev.withColumn("day", day), [], "ts", ["day", "event_type", "ts", "event_id"])
    whole = F.floor("step_seconds").alias("whole_seconds")
    return steps.where(F.col("step_seconds").isNotNull()).groupBy(whole).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {I.HOURLY}, {_STEPS} SELECT event_type, ts, step_seconds, CAST(1 AS BIGINT) AS n_rows FROM steps WHERE step_seconds IS DISTINCT FROM 3600")
def discontinuities(spark, sf_dir):
    found = clean.discontinuities(I.hourly(spark, sf_dir), _TYPE, "ts", expected=HOUR)
    return found.select("event_type", "ts", "step_seconds", "n_rows")


@query(f"WITH {I.HOURLY}, {_STEPS} SELECT event_type, ts, step_seconds, CAST(1 AS BIGINT) AS n_rows FROM steps WHERE step_seconds IN (7200, 10800)")
def discontinuities_among(spark, sf_dir):
    found = clean.discontinuities(I.hourly(spark, sf_dir), _TYPE, "ts", among=[7200.0, 10800.0])
    return found.select("event_type", "ts", "step_seconds", "n_rows")


@query(
    "WITH s AS (SELECT l_returnflag, date_diff('second', lag(l_shipdate) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate), l_shipdate)::DOUBLE AS step_seconds "
    "FROM lineitem) SELECT l_returnflag, step_seconds, count(*) AS n_rows FROM s WHERE step_seconds IS NOT NULL GROUP BY 1, 2"
)
def gap_histogram_repeats(spark, sf_dir):
    """Times that occur many times: most steps are 0."""
    items = I.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate")
    return clean.step_histogram(items, ["l_returnflag"], "l_shipdate")


_LAGS = (1, 24, 168)


@query(
    f"WITH {I.HOURLY_FILLED} SELECT event_type, ts, v, "
    + ", ".join(f"lag(v, {k}) OVER (PARTITION BY event_type ORDER BY ts) AS v_lag_{k}" for k in _LAGS)
    + " FROM hfill"
)
def lag_features(spark, sf_dir):
    return features.lag_and_rolling(I.hourly_filled(spark, sf_dir), _TYPE, "ts", "v", _LAGS, step=HOUR)


@query(
    "SELECT event_id, user_id, ts, v, lag(v, 1) OVER w AS v_lag_1, lag(v, 3) OVER w AS v_lag_3 FROM "
    "(SELECT event_id, user_id, ts, round(value * 100) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
)
def lag_features_irregular(spark, sf_dir):
    """Row lags without a grid, per user."""
    ev = I.events(spark, sf_dir).drop("event_type")
    columns = {f"v_lag_{k}": (lambda w, k=k: F.lag("v", k).over(w)) for k in (1, 3)}
    return features.over_rows(ev, ["user_id"], "ts", columns, back=3, tie=["event_id"])


@query(
    f"WITH {I.HOURLY_FILLED} SELECT event_type, ts, "
    + ", ".join(
        f"CASE WHEN count(v) OVER w{n} = {n} THEN avg(v) OVER w{n} END AS v_mean_{n}" for n in (48, 168)
    )
    + " FROM hfill WINDOW "
    + ", ".join(f"w{n} AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (48, 168))
)
def rolling_mean_past(spark, sf_dir):
    rolled = features.lag_and_rolling(I.hourly_filled(spark, sf_dir), _TYPE, "ts", "v", (), (48, 168), HOUR)
    return rolled.drop("v")


# At the larger test scale every type has events in every hour, so fills run on one series per user.
_USER_HOURLY = "uh AS (SELECT user_id, date_trunc('hour', ts) AS ts, sum(round(value * 100)) AS v FROM events GROUP BY 1, 2)"
_USER_GRID = f"{_USER_HOURLY}, {I.grid_sql('ug', 'uh', ['user_id'], ['v'], '1 hour')}"


def _user_hours(spark, sf_dir):
    return grid.resample_sum(I.events(spark, sf_dir), ["user_id"], "ts", {"v": "v"}, HOUR)


@query(f"WITH {_USER_GRID}, {I.fill_sql('uf', 'ug', ['user_id'], ['v'])} SELECT user_id, ts, round(v, 6) AS v FROM uf")
def interpolate_time(spark, sf_dir):
    out = fill.interpolate_time(_user_hours(spark, sf_dir), ["user_id"], "ts", ["v"], HOUR, grid=True)
    return out.withColumn("v", F.round("v", 6))


# Values of purchases on the grid of all of a user's events: gaps at both ends of a series.
_EDGE = (
    "eh AS (SELECT user_id, date_trunc('hour', ts) AS ts, sum(round(value * 100)) FILTER (WHERE event_type = 'purchase') AS v "
    f"FROM events GROUP BY 1, 2), {I.grid_sql('eg', 'eh', ['user_id'], ['v'], '1 hour')}"
)


def _edge_hours(spark, sf_dir):
    ev = I.events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("v")))
    return grid.resample_sum(ev, ["user_id"], "ts", {"v": "v"}, HOUR)


@query(f"WITH {_EDGE}, {I.fill_sql('ef', 'eg', ['user_id'], ['v'], both=True)} SELECT user_id, ts, round(v, 6) AS v FROM ef")
def interpolate_time_both(spark, sf_dir):
    out = fill.interpolate_time(_edge_hours(spark, sf_dir), ["user_id"], "ts", ["v"], HOUR, both_edges=True, grid=True)
    return out.withColumn("v", F.round("v", 6))


def _near_sql(keys: str) -> tuple[str, str]:
    back = f"last_value(v IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"first_value(v IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return back, ahead


@query(f"WITH {_EDGE} SELECT user_id, ts, coalesce(v, ({_near_sql('user_id')[0]} + {_near_sql('user_id')[1]}) / 2) AS v FROM eg")
def fill_midpoint(spark, sf_dir):
    return fill.fill_midpoint(_edge_hours(spark, sf_dir), ["user_id"], "ts", ["v"], HOUR, grid=True)


@query(
    f"WITH {I.HOURLY_GRID} SELECT event_type, ts, coalesce(v, (lag(v) OVER w + lead(v) OVER w) / 2) AS v FROM hgrid "
    "WINDOW w AS (PARTITION BY event_type ORDER BY ts)"
)
def fill_neighbor_mean(spark, sf_dir):
    return fill.fill_neighbour_mean(I.hourly_grid(spark, sf_dir), _TYPE, "ts", ["v"], HOUR)


def _mean_sql(unit: str, label: str = "") -> str:
    return f"m AS (SELECT event_type, date_trunc('{unit}', ts)::TIMESTAMP{label} AS ts, avg(round(value * 100)) AS v FROM events GROUP BY 1, 2)"


@query(f"WITH {_mean_sql('hour')}, {I.grid_sql('mg', 'm', ['event_type'], ['v'], '1 hour')} SELECT event_type, ts, v FROM mg")
def resample_hour_mean(spark, sf_dir):
    return grid.resample_mean(I.events(spark, sf_dir), _TYPE, "ts", ["v"], HOUR)


@query(
    "WITH m AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, avg(round(o_totalprice * 100)) AS v, avg(o_custkey) AS customer "
    f"FROM orders GROUP BY 1), {I.grid_sql('mg', 'm', [], ['v', 'customer'], '1 day')} SELECT ts, v, customer FROM mg"
)
def resample_day_mean(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("ts"), I.cents("o_totalprice").alias("v"), F.col("o_custkey").alias("customer")
    )
    return grid.resample_mean(orders, [], "ts", ["v", "customer"], DAY)


@query(
    "WITH m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS month, avg(round(o_totalprice * 100)) AS power FROM orders GROUP BY 1, 2), "
    "g AS (SELECT series, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY 1) "
    "SELECT g.series, last_day(g.month)::TIMESTAMP AS ts, m.power FROM g LEFT JOIN m ON g.series = m.series AND g.month = m.month"
)
def resample_month_mean(spark, sf_dir):
    return grid.resample_month_mean(I.priority_orders(spark, sf_dir), ["series"], "ts", ["power"])


@query(
    f"WITH {I.HOURLY_FILLED}, l AS (SELECT event_type, ts, v, lag(v, 1) OVER w AS l1, lag(v, 24) OVER w AS l24, lag(v, 168) OVER w AS l168 "
    "FROM hfill WINDOW w AS (PARTITION BY event_type ORDER BY ts)) SELECT event_type, ts, v, CAST(3 AS INTEGER) AS n_steps, l1 AS newest, l168 AS oldest, "
    "CAST(hour(ts) AS DOUBLE) AS static_hour FROM l WHERE l168 IS NOT NULL"
)
def make_sequences(spark, sf_dir):
    lagged = features.lag_and_rolling(I.hourly_filled(spark, sf_dir), _TYPE, "ts", "v", (168, 1, 24), step=HOUR)
    rows = lagged.withColumn("hour", F.hour("ts")).dropna("any")
    packed = features.make_sequences(rows, ["event_type", "ts"], ["v_lag_168", "hour", "v_lag_1", "v_lag_24"], "v")
    return packed.select(
        "event_type", "ts", "v", F.size("sequence").alias("n_steps"), F.col("sequence")[0].alias("newest"),
        F.col("sequence")[2].alias("oldest"), F.col("static")[0].alias("static_hour"),
    )


# --- whole plans ------------------------------------------------------------------------------

_SLOT_OUT = ", ".join(I._SLOT_VALUES)


@query(f"WITH {I.SLOTS_CLEAN} SELECT ts, is_interpolated, {_SLOT_OUT} FROM sfill")
def clean_national(spark, sf_dir):
    cleaned = clean_slots(I.slot_sources(spark, sf_dir), "settlement_date", "settlement_period", time="ts")
    return cleaned.select("ts", "is_interpolated", *I._SLOT_VALUES)


@query(f"WITH {I.SLOTS_CLEAN} SELECT count(*) AS n_rows, CAST(sum(is_interpolated) AS BIGINT) AS n_filled FROM sfill")
def filled_row_count(spark, sf_dir):
    cleaned = clean_slots(I.slot_sources(spark, sf_dir), "settlement_date", "settlement_period", time="ts")
    return cleaned.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("is_interpolated").alias("n_filled"))


@query(
    f"WITH {I.SLOTS_CLEAN}, s AS (SELECT src, ts, date_diff('second', lag(ts) OVER (ORDER BY src, day, settlement_period), ts)::DOUBLE AS step_seconds FROM timed) "
    "SELECT step_seconds, count(*) AS n_rows FROM s WHERE step_seconds IS NOT NULL GROUP BY 1"
)
def gap_histogram_slots(spark, sf_dir):
    """Steps between slots in source order, before any repair: overlaps show as steps back."""
    stacked = stack_sources(I.slot_sources(spark, sf_dir), "settlement_date", "settlement_period", "ts")
    order = ["_source", "settlement_date", "settlement_period"]
    return clean.step_histogram(stacked, [], "ts", order, F.struct("_source", "settlement_date"))


_FEATURE_LAGS = ", ".join(f"lag(demand, {k}) OVER w AS demand_lag_{k}" for k in (1, 2, 48, 96, 336))
_FEATURE_MEANS = ", ".join(f"CASE WHEN count(demand) OVER w{n} = {n} THEN avg(demand) OVER w{n} END AS demand_mean_{n}" for n in (48, 336))
_FEATURES_SQL = (
    f"{I.SLOTS_CLEAN}, feat AS (SELECT *, {_FEATURE_LAGS}, {_FEATURE_MEANS}, coalesce(flow_a, 0) + coalesce(flow_b, 0) AS net_import, "
    "CASE WHEN wind_capacity <> 0 THEN wind / wind_capacity END AS wind_factor FROM sfill WINDOW w AS (ORDER BY ts), "
    + ", ".join(f"w{n} AS (ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (48, 336))
    + ")"
)
_FEATURE_COLUMNS = [
    "is_interpolated", *I._SLOT_VALUES, *(f"demand_lag_{k}" for k in (1, 2, 48, 96, 336)), "demand_mean_48", "demand_mean_336",
    "net_import", "wind_factor",
]


def _slot_features(spark, sf_dir):
    cleaned = clean_slots(I.slot_sources(spark, sf_dir), "settlement_date", "settlement_period", time="ts")
    ratios = {"wind_factor": ("wind", "wind_capacity")}
    return build_features(cleaned, "ts", "demand", ["flow_a", "flow_b"], ratios)


@query(
    f"WITH {_FEATURES_SQL} SELECT ts, {', '.join(c for c in _FEATURE_COLUMNS)}, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, "
    "round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS weekday_cos, "
    "round(sin(2 * pi() * (month(ts) - 1) / 12), 6) + 0.0 AS month_sin FROM feat WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _FEATURE_COLUMNS)
)
def build_slot_features(spark, sf_dir):
    encoded = encode_features(_slot_features(spark, sf_dir))
    cycles = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("hour_sin", "weekday_cos", "month_sin")]
    return encoded.select("ts", *_FEATURE_COLUMNS, "is_weekend", *cycles)


_POWER_ORDER = ["o_orderkey"]
_PANEL_SQL = (
    "pw AS (SELECT o_orderpriority AS series, year(o_orderdate) AS part, o_orderdate AS ts, round(o_totalprice * 100) AS power "
    "FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate), o_orderdate ORDER BY o_orderkey) = 1), "
    "pm AS (SELECT series, part, date_trunc('day', ts)::TIMESTAMP AS ts, avg(power) AS power FROM pw GROUP BY 1, 2, 3), "
    + I.grid_sql("pg", "pm", ["series", "part"], ["power"], "1 day")
    + ", pf AS (SELECT series, part, ts, coalesce(power, (last_value(power IGNORE NULLS) OVER (PARTITION BY series, part ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
    "+ first_value(power IGNORE NULLS) OVER (PARTITION BY series, part ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / 2) AS power FROM pg), "
    f"{I.WEATHER}, pj AS (SELECT p.series, p.ts, p.power, w.temperature, w.humidity FROM pf p LEFT JOIN wx w ON p.ts = w.ts), "
    "ps AS (SELECT * FROM pj QUALIFY dense_rank() OVER (PARTITION BY series ORDER BY ts) > 5), "
    + I.fill_sql("pz", "ps", ["series"], ["power", "temperature", "humidity"], both=True)
)


def _panel(spark, sf_dir):
    return clean_panel(
        I.priority_orders(spark, sf_dir), I.weather(spark, sf_dir), "series", "part", "ts", "power",
        _POWER_ORDER, I.WEATHER_ORDER, step=DAY, drop=["o_orderkey", "cloud", *I.WEATHER_ORDER],
    )


@query(f"WITH {_PANEL_SQL} SELECT series, ts, power, round(temperature, 6) AS temperature, round(humidity, 6) AS humidity FROM pz", name="clean_panel")
def clean_panel_of_orders(spark, sf_dir):
    out = _panel(spark, sf_dir)
    return out.select("series", "ts", "power", *[F.round(c, 6).alias(c) for c in ("temperature", "humidity")])


@query(
    f"WITH {_PANEL_SQL}, pl AS (SELECT series, ts, power, temperature, lag(power, 1) OVER w AS power_lag_1, lag(power, 7) OVER w AS power_lag_7 FROM pz "
    "WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, ts, power, power_lag_1, power_lag_7, round(temperature, 6) AS temperature, "
    "CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM pl WHERE power_lag_7 IS NOT NULL AND temperature IS NOT NULL",
    name="panel_features",
)
def panel_features_of_orders(spark, sf_dir):
    out = panel_features(_panel(spark, sf_dir), "series", "ts", "power", ["temperature"], (1, 7), DAY)
    return out.select("series", "ts", "power", "power_lag_1", "power_lag_7", F.round("temperature", 6).alias("temperature"), "is_weekend")


@query(
    f"WITH {I.WEATHER}, l AS (SELECT ts, temperature, "
    + ", ".join(f"lag(temperature, {k}) OVER (ORDER BY ts) AS temperature_lag_{k}" for k in (1, 24, 48, 72, 168))
    + " FROM wx) SELECT * FROM l WHERE temperature_lag_168 IS NOT NULL",
    name="weather_lags",
)
def weather_row_lags(spark, sf_dir):
    weather = I.weather(spark, sf_dir).select("ts", "temperature", *I.WEATHER_ORDER)
    return weather_lags(weather, "ts", "temperature", I.WEATHER_ORDER).drop(*I.WEATHER_ORDER)


_WEATHER_LAGS = (1, 24, 48, 72, 168)
_ROW_ORDER = f"ORDER BY ts, {', '.join(I.WEATHER_ORDER)}"


@query(
    "WITH w0 AS (SELECT l_shipdate AS ts, l_quantity AS temperature, CASE WHEN l_linenumber <> 3 THEN round(l_tax * 100) END AS pressure, "
    f"{', '.join(I.WEATHER_ORDER)} FROM lineitem), "
    f"w1 AS (SELECT *, coalesce(pressure, (lag(pressure) OVER ({_ROW_ORDER}) + lead(pressure) OVER ({_ROW_ORDER})) / 2) AS filled FROM w0), "
    f"w2 AS (SELECT ts, temperature, filled AS pressure FROM w1 QUALIFY row_number() OVER (PARTITION BY ts {_ROW_ORDER}) = 1), "
    "w3 AS (SELECT *, " + ", ".join(f"lag(temperature, {k}) OVER (ORDER BY ts) AS temperature_lag_{k}" for k in _WEATHER_LAGS)
    + " FROM w2) SELECT * FROM w3 WHERE temperature_lag_168 IS NOT NULL AND pressure IS NOT NULL",
    name="clean_weather",
)
def clean_weather_of_items(spark, sf_dir):
    """Pressure has gaps, filled from the rows around them while repeated times are still there."""
    items = I.table(spark, sf_dir, "lineitem")
    pressure = F.when(F.col("l_linenumber") != 3, I.cents("l_tax"))
    rows = items.select(F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("temperature"), pressure.alias("pressure"), *I.WEATHER_ORDER)
    return clean_weather(rows, "ts", ["pressure"], "temperature", I.WEATHER_ORDER, _WEATHER_LAGS).drop(*I.WEATHER_ORDER)
