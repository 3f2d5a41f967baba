"""The series that queries run on, derived from the given tables, with the same text in SQL.

Money is carried as whole cents in doubles: sums of whole numbers do not depend on their order,
so results of different engines can be compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemill.functions.timecols import DAY, HALF_HOUR, HOUR, epoch_seconds
from tidemill.operators.features import lag_and_rolling
from tidemill.operators.fill import interpolate_time
from tidemill.operators.grid import reindex, resample_sum
from tidemill.functions.numeric import round_half_even


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100)


# --- hourly panel: events by type -------------------------------------------------------------


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", cents("value").alias("v"))


EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type, round(value * 100) AS v FROM events)"


def hourly(spark, sf_dir) -> DataFrame:
    """(event_type, ts, v): cents per hour, only hours that hold events."""
    return resample_sum(events(spark, sf_dir), ["event_type"], "ts", {"v": "v"}, HOUR)


HOURLY = (
    "hourly AS (SELECT event_type, date_trunc('hour', ts) AS ts, sum(round(value * 100)) AS v "
    "FROM events GROUP BY 1, 2)"
)


def hourly_grid(spark, sf_dir) -> DataFrame:
    return reindex(hourly(spark, sf_dir), ["event_type"], "ts", HOUR, aligned=True)


def grid_sql(name: str, src: str, keys: list[str], cols: list[str], step: str) -> str:
    """CTE: `src` put on a regular grid per key."""
    k = "".join(f"{c}, " for c in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    on = " AND ".join([*(f"g.{c} = s.{c}" for c in keys), "g.ts = s.ts"])
    gk = "".join(f"g.{c}, " for c in keys)
    sc = ", ".join(f"s.{c}" for c in cols)
    return (
        f"{name}_g AS (SELECT {k}unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts FROM {src}{group}), "
        f"{name} AS (SELECT {gk}g.ts, {sc} FROM {name}_g g LEFT JOIN {src} s ON {on})"
    )


HOURLY_GRID = f"{HOURLY}, {grid_sql('hgrid', 'hourly', ['event_type'], ['v'], '1 hour')}"


def fill_sql(name: str, src: str, keys: list[str], cols: list[str], both: bool = False, rounded: bool = False, extra: str = "") -> str:
    """CTE: time interpolation of `cols` in `src`, same arithmetic as the operator."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    back = f"OVER ({part}ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"OVER ({part}ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near, out = [], []
    for c in cols:
        seen = f"CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END"
        near += [
            f"last_value({c} IGNORE NULLS) {back} AS pv_{c}",
            f"last_value({seen} IGNORE NULLS) {back} AS pt_{c}",
            f"first_value({c} IGNORE NULLS) {ahead} AS nv_{c}",
            f"first_value({seen} IGNORE NULLS) {ahead} AS nt_{c}",
        ]
        line = (
            f"((nv_{c} - pv_{c}) / CAST(nt_{c} - pt_{c} AS DOUBLE)) * (epoch_us(ts) - pt_{c}) + pv_{c}"
        )
        edge = f" WHEN nt_{c} IS NOT NULL THEN nv_{c}" if both else ""
        value = (
            f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pt_{c} IS NOT NULL AND nt_{c} IS NOT NULL THEN {line} "
            f"WHEN pt_{c} IS NOT NULL THEN pv_{c}{edge} END"
        )
        out.append((f"round_even({value}, 0)" if rounded else value) + f" AS {c}")
    k = "".join(f"{c}, " for c in keys)
    return (
        f"{name}_n AS (SELECT *, {', '.join(near)} FROM {src}), "
        f"{name} AS (SELECT {k}ts, {extra}{', '.join(out)} FROM {name}_n)"
    )


def filled(df: DataFrame, keys: list[str], step: int, cols: list[str] = ["v"]) -> DataFrame:
    out = interpolate_time(df, keys, "ts", cols, step, grid=True)
    return out.withColumns({c: round_half_even(c) for c in cols})


def hourly_filled(spark, sf_dir) -> DataFrame:
    """Whole cents on a complete hourly grid (leading gaps, if any, stay null)."""
    return filled(hourly(spark, sf_dir), ["event_type"], HOUR)


HOURLY_FILLED = f"{HOURLY_GRID}, {fill_sql('hfill', 'hgrid', ['event_type'], ['v'], rounded=True)}"


# --- long daily series: orders ----------------------------------------------------------------


def daily(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), cents("o_totalprice").alias("v"))
    return resample_sum(orders, [], "ts", {"v": "v"}, DAY)


DAILY = (
    "daily AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(round(o_totalprice * 100)) AS v "
    "FROM orders GROUP BY 1)"
)


def daily_filled(spark, sf_dir) -> DataFrame:
    return filled(daily(spark, sf_dir), [], DAY)


DAILY_FILLED = (
    f"{DAILY}, {grid_sql('dgrid', 'daily', [], ['v'], '1 day')}, {fill_sql('dfill', 'dgrid', [], ['v'], rounded=True)}"
)


def forecasts(spark, sf_dir) -> DataFrame:
    """(ts, y, a, b): two simple forecasts of the daily series, last week's value and the past
    week's mean; whole-number sums keep the mean exact.
    """
    base = lag_and_rolling(daily_filled(spark, sf_dir), [], "ts", "v", [7], [7], DAY)
    named = base.select("ts", F.col("v").alias("y"), F.col("v_lag_7").alias("a"), F.col("v_mean_7").alias("b"))
    return named.dropna("any")


FORECASTS = (
    f"{DAILY_FILLED}, fc0 AS (SELECT ts, v AS y, lag(v, 7) OVER (ORDER BY ts) AS a, "
    "avg(v) OVER (ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b, "
    "count(v) OVER (ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS nb FROM dfill), "
    "fc AS (SELECT ts, y, a, b FROM fc0 WHERE a IS NOT NULL AND nb = 7 AND y IS NOT NULL)"
)


def intervals(spark, sf_dir) -> DataFrame:
    """Forecasts with bounds 40 % around the past mean."""
    fc = forecasts(spark, sf_dir)
    return fc.select("ts", "y", (F.col("b") * 0.6).alias("lower"), F.col("b").alias("median"), (F.col("b") * 1.4).alias("upper"), "a")


INTERVALS = f"{FORECASTS}, iv AS (SELECT ts, y, b * 0.6::DOUBLE AS lower, b AS median, b * 1.4::DOUBLE AS upper, a FROM fc)"


# --- daily panel with weather -----------------------------------------------------------------


def priority_orders(spark, sf_dir) -> DataFrame:
    """One row per order: series key, source part (year), time, value and source order."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderpriority").alias("series"),
        F.year("o_orderdate").alias("part"),
        F.col("o_orderdate").alias("ts"),
        cents("o_totalprice").alias("power"),
        "o_orderkey",
    )


def weather(spark, sf_dir) -> DataFrame:
    """Rows with repeated times, as weather files have; the order columns are total."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("temperature"),
        cents("l_discount").alias("humidity"),
        cents("l_tax").alias("cloud"),
        *WEATHER_ORDER,
    )


WEATHER_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
WEATHER = (
    "wx AS (SELECT ts, temperature, humidity, cloud FROM (SELECT l_shipdate AS ts, l_quantity AS temperature, "
    "round(l_discount * 100) AS humidity, round(l_tax * 100) AS cloud, row_number() OVER (PARTITION BY l_shipdate "
    f"ORDER BY {', '.join(WEATHER_ORDER)}) AS rn FROM lineitem) WHERE rn = 1)"
)


# --- national slots ---------------------------------------------------------------------------

_SLOT_COLUMNS = {"demand": "purchase", "flow_a": "view", "flow_b": "click", "wind": "signup", "wind_capacity": "error"}


def years_of(df: DataFrame, day: str, most: int = 500) -> list[int]:
    """All calendar years from the first to the last day of the table."""
    first, last = df.agg(F.min(F.year(day)), F.max(F.year(day))).first()
    if first is None:
        return []
    if last - first >= most:
        raise ValueError(f"{day} spans over {most} years")
    return list(range(first, last + 1))


def slot_sources(spark, sf_dir) -> list[DataFrame]:
    """Three files of half-hour slots whose days overlap; the second lacks one column.

    Dates start at 01:00, so the last slots of a date (49, 50) lie in the next day's first hour,
    as on a clock-change day. Events of a type without a column make their slot, and add to none of its values.
    """
    ev = events(spark, sf_dir)
    day = F.to_date(F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(1)))
    slot = (F.floor(epoch_seconds("ts") / HALF_HOUR) - F.unix_date(day) * 48 + 1).cast("int")
    sums = [F.sum(F.when(F.col("event_type") == t, F.col("v"))).alias(c) for c, t in _SLOT_COLUMNS.items()]
    raw = (
        ev.withColumns({"settlement_period": slot, "_day": day})
        .groupBy("_day", "settlement_period")
        .agg(*sums)
        .withColumn("settlement_date", F.date_format("_day", "d-MMM-yyyy"))
    )
    day = F.dayofmonth("_day")
    return [
        raw.where(day <= 11).drop("_day"),
        raw.where((day >= 11) & (day <= 21)).drop("_day", "flow_b"),
        raw.where(day >= 21).drop("_day"),
    ]


_SLOT_SUMS = ", ".join(
    f"sum(round(value * 100)) FILTER (WHERE event_type = '{t}') AS {c}" for c, t in _SLOT_COLUMNS.items()
)
_SLOT_VALUES = ["settlement_period", *_SLOT_COLUMNS]
SLOTS_CLEAN = (
    "raw AS (SELECT date_trunc('day', ts - INTERVAL 1 HOUR)::TIMESTAMP AS day, "
    "CAST((floor(epoch(ts) / 1800) * 1800 - epoch(date_trunc('day', ts - INTERVAL 1 HOUR)::TIMESTAMP)) / 1800 AS INTEGER) + 1 "
    f"AS settlement_period, {_SLOT_SUMS} FROM events GROUP BY 1, 2), "
    "stacked AS (SELECT 0 AS src, * FROM raw WHERE day(day) <= 11 UNION ALL "
    "SELECT 1, * REPLACE (NULL AS flow_b) FROM raw WHERE day(day) BETWEEN 11 AND 21 UNION ALL "
    "SELECT 2, * FROM raw WHERE day(day) >= 21), "
    "timed AS (SELECT *, day + (settlement_period - 1) * INTERVAL 30 MINUTE AS ts FROM stacked), "
    "uniq AS (SELECT * FROM timed QUALIFY row_number() OVER (PARTITION BY ts ORDER BY src, day, settlement_period) = 1), "
    + grid_sql("sgrid", "uniq", [], _SLOT_VALUES, "30 minutes")
    + ", sflag AS (SELECT *, CAST("
    + " OR ".join(f"{c} IS NULL" for c in _SLOT_VALUES)
    + " AS INTEGER) AS is_interpolated FROM sgrid), "
    + fill_sql("sfill", "sflag", [], _SLOT_VALUES, rounded=True, extra="is_interpolated, ")
)
