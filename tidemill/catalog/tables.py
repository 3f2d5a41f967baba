"""Queries: sources and sinks, projections, filters, dedup, unions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import inputs as I
from tidemill.catalog.registry import registry
from tidemill.functions import calendar as C, numeric as N
from tidemill.functions.timecols import epoch_seconds, from_seconds, parse_day, slot_timestamp
from tidemill.operators import filters, joins
from tidemill.operators.clean import dedup_keep_first, union_by_name
from tidemill.operators.metrics import point_metrics
from tidemill.operators.profile import iqr_bounds, null_counts
from tidemill.operators.scale import Scaler, fit_scaler
from tidemill.operators.split import split_years
from tidemill.session import scratch_path
from tidemill.sources import tables as S

QUERIES, ORACLES, query = registry()


# --- sources and sinks ------------------------------------------------------------------------

_EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE"


@query("SELECT event_id, ts, event_type, value FROM events")
def scan_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    S.write_csv(I.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"), path)
    return S.scan_csv(spark, path, _EVENT_SCHEMA)


@query("SELECT ts AS time, value AS power_kw FROM events")
def scan_csv_headerless(spark, sf_dir):
    path = scratch_path(spark, "bare")
    rows = I.table(spark, sf_dir, "events").select("ts", "value")
    rows.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    raw = S.scan_csv(spark, path, "time STRING, power_kw DOUBLE", header=False)
    return raw.withColumn("time", F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))


@query("SELECT event_id, ts, value, event_type AS series FROM events")
def scan_glob_keyed(spark, sf_dir):
    path = scratch_path(spark, "keyed")
    rows = I.table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    S.write_csv(rows, path, ["event_type"])
    found = S.scan_csv_by_name(
        spark, f"{path}/event_type=*/*.csv", "event_id BIGINT, ts TIMESTAMP_NTZ, value DOUBLE", "event_type=([^/]+)/", "series"
    )
    return S.usable_sources({"events": found}, ["ts", "value"])["events"]


@query(
    "SELECT k.o_custkey, y.year FROM (SELECT DISTINCT o_custkey FROM orders) k, "
    "(SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS year) y EXCEPT "
    "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) FROM orders"
)
def missing_partitions(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return S.missing_parts(orders, "o_custkey", "year", I.years_of(I.table(spark, sf_dir, "orders"), "o_orderdate"))


@query(
    f"WITH {I.FORECASTS}, long AS (SELECT ts, y, 'a' AS model, a AS p FROM fc UNION ALL SELECT ts, y, 'b', b FROM fc) "
    "SELECT model, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae FROM long GROUP BY model"
)
def metrics_json_roundtrip(spark, sf_dir):
    long = joins.stack_predictions(I.forecasts(spark, sf_dir), ["ts"], "y", {"a": "a", "b": "b"})
    scores = point_metrics(long, "y_true", "y_pred", ["model"])
    path = scratch_path(spark, "metrics")
    S.write_json(scores, path)
    back = S.read_json(spark, path, "model string, rmse double, mae double")
    return back.select("model", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


_ITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CUT = "(SELECT max(l_shipdate) - INTERVAL 1 YEAR FROM lineitem)"
_POP = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_ITEM_FEATURES))
_SCALED = ", ".join(f"round(({c} - m{i}) / s{i}, 6) AS {c}" for i, c in enumerate(_ITEM_FEATURES))


@query(
    f"WITH p AS (SELECT {_POP} FROM lineitem WHERE l_shipdate < {_CUT}) "
    f"SELECT l_orderkey, l_linenumber, {_SCALED} FROM lineitem, p WHERE l_shipdate >= {_CUT}"
)
def scaler_apply_saved(spark, sf_dir):
    items = split_years(I.table(spark, sf_dir, "lineitem"), "l_shipdate", 1)
    path = scratch_path(spark, "scaler")
    fit_scaler(items.where("split = 'train'"), _ITEM_FEATURES).save(spark, path)
    scaled = Scaler.load(spark, path).transform(items.where("split = 'test'"))
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _ITEM_FEATURES])


# --- projections and scalar functions ---------------------------------------------------------


@query("SELECT event_id AS id, ts, value AS power_kw FROM events")
def project_columns(spark, sf_dir):
    renamed = I.table(spark, sf_dir, "events").withColumnsRenamed({"event_id": "id", "value": "power_kw"})
    return renamed.drop("props", "event_type", "user_id", "not_there")


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d-%b-%Y') AS day_text, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders")
def parse_custom_date(spark, sf_dir):
    text = I.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "d-MMM-yyyy").alias("day_text"))
    return text.withColumn("day", parse_day("day_text"))


@query(
    "WITH s AS (SELECT event_id, date_trunc('day', ts - INTERVAL 2 HOUR)::TIMESTAMP AS day, ts FROM events) "
    "SELECT event_id, CAST(floor(date_diff('second', day, date_trunc('second', ts)) / 1800) AS INTEGER) + 1 AS slot, "
    "day + floor(date_diff('second', day, date_trunc('second', ts)) / 1800)::INTEGER * INTERVAL 30 MINUTE AS slot_ts FROM s",
    name="slot_timestamp"
)
def slot_timestamp_of_event(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events").select("event_id", "ts")
    day = F.to_date(F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(2)))
    slot = (F.floor((epoch_seconds("ts") - F.unix_date(day).cast("long") * 86_400) / 1_800) + 1).cast("int")
    return ev.select("event_id", slot.alias("slot"), slot_timestamp(day, slot).alias("slot_ts"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(epoch(l_shipdate) AS BIGINT) AS unix_s, l_shipdate AS ts FROM lineitem"
)
def epoch_to_ts(spark, sf_dir):
    items = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", epoch_seconds("l_shipdate").alias("unix_s"))
    return items.withColumn("ts", from_seconds("unix_s"))


@query(
    "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, "
    "CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, "
    "CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day FROM events"
)
def calendar_parts(spark, sf_dir):
    ev = C.with_calendar(I.table(spark, sf_dir, "events").select("event_id", "ts"), "ts")
    return ev.withColumns({"year": F.year("ts"), "minute_of_day": C.minute_of_day("ts")}).drop("ts")


@query(
    "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring' "
    "WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season, "
    "CASE WHEN isodow(o_orderdate) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS week_type FROM orders"
)
def season_label(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", C.season("o_orderdate").alias("season"), C.week_type("o_orderdate").alias("week_type"))


_FLOWS = {"flow_a": "CASE WHEN l_quantity > 25 THEN l_quantity END", "flow_b": "nullif(round(l_discount * 100), 0)", "flow_c": "nullif(round(l_tax * 100), 0)"}


@query(
    "SELECT l_orderkey, l_linenumber, coalesce(flow_a, 0) + coalesce(flow_b, 0) + coalesce(flow_c, 0) AS net_import FROM "
    f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in _FLOWS.items())} FROM lineitem)"
)
def row_sum_nullsafe(spark, sf_dir):
    flows = I.table(spark, sf_dir, "lineitem").withColumns({n: F.expr(e) for n, e in _FLOWS.items()})
    return flows.select("l_orderkey", "l_linenumber", N.row_sum(list(_FLOWS)).alias("net_import"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS ratio FROM lineitem")
def safe_ratio(spark, sf_dir):
    return I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.safe_ratio("l_discount", "l_tax").alias("ratio"))


def _angle(fn: str, part: str, period: int) -> str:
    return f"round({fn}(2 * pi() * {part} / {period}), 6) + 0.0"


@query(
    f"SELECT event_id, {_angle('sin', 'hour(ts)', 24)} AS hour_sin, {_angle('cos', 'hour(ts)', 24)} AS hour_cos, "
    f"{_angle('sin', '(isodow(ts) - 1)', 7)} AS weekday_sin, {_angle('cos', '(isodow(ts) - 1)', 7)} AS weekday_cos, "
    f"{_angle('sin', '(month(ts) - 1)', 12)} AS month_sin, {_angle('cos', '(month(ts) - 1)', 12)} AS month_cos FROM events"
)
def cyclical_encoding(spark, sf_dir):
    ev = C.with_calendar(I.table(spark, sf_dir, "events").select("event_id", "ts"), "ts")
    names = [f"{part}_{fn}" for part in ("hour", "weekday", "month") for fn in ("sin", "cos")]
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    return C.with_cycles(ev).select("event_id", *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names])


@query("SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_price, round(o_totalprice, 2) AS price FROM orders")
def log1p_roundtrip(spark, sf_dir):
    logged = I.table(spark, sf_dir, "orders").select("o_orderkey", F.log1p("o_totalprice").alias("log_price"))
    return logged.select("o_orderkey", F.round("log_price", 6).alias("log_price"), F.round(F.expm1("log_price"), 2).alias("price"))


@query(
    "SELECT event_id, " + ", ".join(f"CAST(event_type = '{t}' AS INTEGER) AS icon_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events"
)
def one_hot(spark, sf_dir):
    return N.one_hot(I.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", prefix="icon")


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half_quantity FROM lineitem")
def round_half_even(spark, sf_dir):
    items = I.table(spark, sf_dir, "lineitem").withColumn("half_quantity", F.col("l_quantity") / 2)
    return items.select("l_orderkey", "l_linenumber", N.round_half_even("half_quantity").alias("half_quantity"))


@query(
    f"SELECT l_orderkey, l_linenumber, CAST(flow_a IS NULL OR flow_b IS NULL OR flow_c IS NULL AS INTEGER) AS has_null FROM "
    f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in _FLOWS.items())} FROM lineitem)"
)
def null_row_flag(spark, sf_dir):
    flows = I.table(spark, sf_dir, "lineitem").withColumns({n: F.expr(e) for n, e in _FLOWS.items()})
    return flows.select("l_orderkey", "l_linenumber", N.any_null(list(_FLOWS)).alias("has_null"))


@query(
    f"WITH {I.FORECASTS} SELECT ts, a - y AS error, abs(a - y) AS abs_error, CASE WHEN y <> 0 THEN abs(a - y) / abs(y) END AS rel_error FROM fc"
)
def error_columns(spark, sf_dir):
    return N.with_errors(I.forecasts(spark, sf_dir), "y", "a").select("ts", "error", "abs_error", "rel_error")


# --- filters, limits, sorts -------------------------------------------------------------------


@query("SELECT event_id, ts, value FROM events WHERE ts < (SELECT min(ts) + INTERVAL 7 DAY FROM events)")
def first_week_slice(spark, sf_dir):
    return filters.first_days(I.table(spark, sf_dir, "events").select("event_id", "ts", "value"), "ts", 7)


@query(
    "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"
)
def closed_range_slice(spark, sf_dir):
    items = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    start, end = F.expr("timestamp_ntz'1996-01-01'"), F.expr("timestamp_ntz'1996-12-31'")
    return filters.closed_range(items, "l_shipdate", start, end)


@query("SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def day_inclusive_slice(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events").select("event_id", "ts")
    return filters.day_range(ev, "ts", F.lit("2024-01-05"), F.lit("2024-01-09"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997 THEN 'test' ELSE 'train' END AS part FROM orders"
)
def entity_year_split(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    mask = (F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1997)
    test, train = filters.split_by_mask(orders, mask)
    parts = union_by_name([test.withColumn("part", F.lit("test")), train.withColumn("part", F.lit("train"))])
    return parts.select("o_orderkey", "part")


@query(
    f"SELECT l_orderkey, l_linenumber, flow_a, flow_b, flow_c FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _FLOWS.items())} FROM lineitem) "
    "WHERE flow_a IS NOT NULL AND flow_b IS NOT NULL AND flow_c IS NOT NULL"
)
def drop_any_null(spark, sf_dir):
    flows = I.table(spark, sf_dir, "lineitem").withColumns({n: F.expr(e) for n, e in _FLOWS.items()})
    return flows.select("l_orderkey", "l_linenumber", *_FLOWS).dropna("any")


@query("SELECT event_id, event_type, ts FROM events QUALIFY dense_rank() OVER (PARTITION BY event_type ORDER BY ts) > 5")
def skip_first_n(spark, sf_dir):
    return filters.skip_first(I.table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["event_type"], "ts", 5)


@query(
    "SELECT event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 15"
)
def last_n(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return filters.last_rows(ev, ["event_type"], "ts", 15, ["event_id"])


@query(
    "SELECT event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1200"
)
def last_n_long(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return filters.last_rows(ev, ["event_type"], "ts", 1200, ["event_id"])


@query(
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) "
    "SELECT o_orderkey, round(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), o_totalprice)), 4) AS price FROM orders, q"
)
def winsorize_iqr(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    bounds = iqr_bounds(orders, [], "o_totalprice").first()
    clipped = N.clip("o_totalprice", F.lit(bounds["lower"]), F.lit(bounds["upper"]))
    return orders.select("o_orderkey", F.round(clipped, 4).alias("price"))


_NULL_COUNT = " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS n_null FROM f" for n in [*_FLOWS, "l_quantity"]
)


@query(f"WITH f AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _FLOWS.items())} FROM lineitem) {_NULL_COUNT}", name="null_counts")
def null_counts_of_flows(spark, sf_dir):
    flows = I.table(spark, sf_dir, "lineitem").withColumns({n: F.expr(e) for n, e in _FLOWS.items()})
    return null_counts(flows, [*_FLOWS, "l_quantity"])


# --- dedup, set operations, joins -------------------------------------------------------------

_SOURCE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@query(
    "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem "
    f"QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_SOURCE_ORDER)}) = 1",
    name="dedup_keep_first"
)
def dedup_first(spark, sf_dir):
    items = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_SOURCE_ORDER)
    return dedup_keep_first(items, ["l_orderkey", "l_linenumber"], _SOURCE_ORDER)


@query(
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL "
    "SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'",
    name="union_by_name"
)
def union_uneven(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    turn = F.expr("timestamp_ntz'1998-01-01'")
    old, new = orders.where(F.col("o_orderdate") < turn), orders.where(F.col("o_orderdate") >= turn)
    return union_by_name([old.drop("o_orderdate"), new.drop("o_orderdate", "o_orderstatus")])


@query(f"WITH {I.DAILY}, {I.WEATHER} SELECT d.ts, d.v, w.temperature, w.humidity FROM daily d LEFT JOIN wx w ON d.ts = w.ts", name="left_join_time")
def left_join_on_time(spark, sf_dir):
    weather = I.weather(spark, sf_dir)
    joined = joins.left_join_time(I.daily(spark, sf_dir), weather, "ts", I.WEATHER_ORDER)
    return joined.select("ts", "v", "temperature", "humidity")


@query(f"WITH {I.FORECASTS} SELECT d.ts, d.v, fc.a, fc.b FROM dfill d JOIN fc ON d.ts = fc.ts")
def align_predictions(spark, sf_dir):
    predictions = I.forecasts(spark, sf_dir).drop("y")
    return joins.align(I.daily_filled(spark, sf_dir), predictions, ["ts"])


@query(f"WITH {I.FORECASTS} SELECT ts, y AS y_true, a AS last_week, b AS week_mean FROM fc")
def compare_models_wide(spark, sf_dir):
    models = {"last_week": "a", "week_mean": "b"}
    long = joins.stack_predictions(I.forecasts(spark, sf_dir), ["ts"], "y", models)
    return joins.models_side_by_side(long, ["ts"], list(models))
