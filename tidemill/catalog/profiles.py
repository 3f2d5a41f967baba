"""Queries: profiles, distributions, correlations, autocorrelation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import inputs as I
from tidemill.catalog.registry import registry
from tidemill.functions import calendar as C
from tidemill.functions.timecols import DAY, HOUR
from tidemill.operators import correlogram, filters, grid, profile as P
from tidemill.operators.quantiles import exact_quantiles

QUERIES, ORACLES, query = registry()


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, avg(round(value * 100)) AS mean FROM events GROUP BY 1")
def profile_hour(spark, sf_dir):
    return P.mean_profile(I.events(spark, sf_dir), {"hour": F.hour("ts")}, "v")


# Events cover one month, so seasons come from the daily order series, by weekday in place of hour.
_SEASONS = {"Winter": "(12, 1, 2)", "Spring": "(3, 4, 5)", "Summer": "(6, 7, 8)", "Autumn": "(9, 10, 11)"}


@query(
    "SELECT CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, "
    + ", ".join(f'avg(round(o_totalprice * 100)) FILTER (WHERE month(o_orderdate) IN {m}) AS "{s}"' for s, m in _SEASONS.items())
    + " FROM orders GROUP BY 1"
)
def profile_season_weekday(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").withColumn("v", I.cents("o_totalprice"))
    return P.pivot_profile(orders, {"weekday": C.weekday("o_orderdate")}, C.season("o_orderdate"), C.SEASONS, "v")


@query(
    "SELECT CAST(hour(ts) AS INTEGER) AS hour, "
    + ", ".join(f'avg(round(value * 100)) FILTER (WHERE month(ts) IN {m}) AS "{s}"' for s, m in _SEASONS.items())
    + " FROM events GROUP BY 1"
)
def profile_season_hour(spark, sf_dir):
    return P.pivot_profile(I.events(spark, sf_dir), {"hour": F.hour("ts")}, C.season("ts"), C.SEASONS, "v")


@query(
    "SELECT CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day, avg(round(value * 100)) AS mean "
    "FROM events GROUP BY 1, 2"
)
def profile_month_tod(spark, sf_dir):
    by = {"month": F.month("ts"), "minute_of_day": C.minute_of_day("ts")}
    return P.mean_profile(I.events(spark, sf_dir), by, "v")


# Years of the supplied orders, for the SQL form; the query takes them from the data.
_YEARS = list(range(1995, 2002))


@query(
    "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, "
    + ", ".join(f"avg(round(o_totalprice * 100)) FILTER (WHERE year(o_orderdate) = {y}) AS y{y}" for y in _YEARS)
    + " FROM orders GROUP BY 1"
)
def pivot_year_month(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").withColumn("v", I.cents("o_totalprice"))
    return P.pivot_profile(orders, {"month": F.month("o_orderdate")}, F.year("o_orderdate"), I.years_of(orders, "o_orderdate"), "v", prefix="y")


_MEASURES = {"quantity": "l_quantity", "price": "round(l_extendedprice * 100)", "tax": "round(l_tax * 100)"}
# Ship dates of the supplied items, for the SQL form.
_SHIP_YEARS = list(range(1995, 2002))


@query(
    " UNION ALL ".join(
        f"SELECT '{m}' AS measure, CAST(month(l_shipdate) AS INTEGER) AS month, "
        + ", ".join(f"avg({e}) FILTER (WHERE year(l_shipdate) = {y}) AS y{y}" for y in _SHIP_YEARS)
        + " FROM lineitem GROUP BY 2"
        for m, e in _MEASURES.items()
    )
)
def pivot_year_month_measures(spark, sf_dir):
    """Three measures: means per month and year in one pass, then turned."""
    items = I.table(spark, sf_dir, "lineitem")
    means = items.groupBy(F.month("l_shipdate").alias("month"), F.year("l_shipdate").alias("year")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg(I.cents("l_extendedprice")).alias("price"), F.avg(I.cents("l_tax")).alias("tax")
    )
    long = means.unpivot(["month", "year"], list(_MEASURES), "measure", "v")
    return P.pivot_profile(long, {"measure": F.col("measure"), "month": F.col("month")}, F.col("year"), I.years_of(items, "l_shipdate"), "v", prefix="y")


@query(
    "SELECT CAST(hour(ts) AS INTEGER) AS hour, avg(round(value * 100)) FILTER (WHERE isodow(ts) < 6) AS \"Weekday\", "
    "avg(round(value * 100)) FILTER (WHERE isodow(ts) >= 6) AS \"Weekend\" FROM events GROUP BY 1"
)
def profile_weektype_hour(spark, sf_dir):
    return P.pivot_profile(I.events(spark, sf_dir), {"hour": F.hour("ts")}, C.week_type("ts"), ["Weekday", "Weekend"], "v")


@query(
    "SELECT CAST(hour(ts) AS INTEGER) AS hour, "
    + ", ".join(f"avg(round(value * 100)) FILTER (WHERE isodow(ts) = {d + 1}) AS weekday_{d}" for d in range(7))
    + " FROM events GROUP BY 1"
)
def heatmap_hour_weekday(spark, sf_dir):
    return P.pivot_profile(I.events(spark, sf_dir), {"hour": F.hour("ts")}, C.weekday("ts"), range(7), "v", prefix="weekday_")


@query(
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, last_day(o_orderdate)::TIMESTAMP AS ts, avg(round(o_totalprice * 100)) AS v FROM orders GROUP BY 1, 2"
)
def monthly_by_year(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), I.cents("o_totalprice").alias("v"))
    return grid.resample_month_mean(orders, [], "ts", ["v"]).withColumn("year", F.year("ts"))


_FENCES = (
    "q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x), "
    "b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)"
)


@query(
    f"WITH x AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100) AS v FROM lineitem), {_FENCES} "
    "SELECT l_orderkey, l_linenumber, v, round(lower, 4) AS lower, round(upper, 4) AS upper FROM x, b WHERE v < lower OR v > upper"
)
def iqr_outliers(spark, sf_dir):
    items = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", I.cents("l_extendedprice").alias("v"))
    found = P.iqr_outliers(items, "v")
    return found.withColumns({c: F.round(c, 4) for c in ("lower", "upper")})


@query(
    f"WITH {I.DAILY_FILLED}, x AS (SELECT ts, v * v AS v FROM dfill WHERE v IS NOT NULL), {_FENCES} "
    "SELECT ts, v FROM x, b WHERE v < lower OR v > upper ORDER BY ts LIMIT 15"
)
def first_outliers(spark, sf_dir):
    """The first 15 outliers of the squared daily series, for display."""
    squared = I.daily_filled(spark, sf_dir).withColumn("v", F.col("v") * F.col("v"))
    return P.iqr_outliers(squared, "v").select("ts", "v").orderBy("ts").limit(15)


@query(
    f"WITH {I.EVENTS}, x AS (SELECT v FROM ev), {_FENCES} "
    "SELECT round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, count(*) FILTER (WHERE v < lower OR v > upper) AS n_outliers FROM x, b"
)
def iqr_report(spark, sf_dir):
    ev = I.events(spark, sf_dir)
    bounds = P.iqr_bounds(ev, [], "v").first()
    outside = (F.col("v") < bounds["lower"]) | (F.col("v") > bounds["upper"])
    q1, q3 = (F.round(F.lit(bounds[c]), 4).alias(c) for c in ("q1", "q3"))
    return ev.agg(F.count_if(outside).alias("n_outliers")).select(q1, q3, "n_outliers")


_BOX = (
    "q AS (SELECT weekday, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY 1), "
    "f AS (SELECT x.weekday, v, q1, median, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM x JOIN q ON x.weekday = q.weekday)"
)


@query(
    f"WITH x AS (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, round(value * 100) AS v FROM events), {_BOX} "
    "SELECT weekday, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, "
    "min(v) FILTER (WHERE inside) AS whisker_low, max(v) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS n_outliers, "
    "count(*) AS n_rows FROM f GROUP BY weekday"
)
def boxplot_stats(spark, sf_dir):
    ev = I.events(spark, sf_dir).withColumn("weekday", C.weekday("ts"))
    return P.boxplot_stats(ev, ["weekday"], "v").withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


_Q = {"q01": 0.01, "median": 0.5, "q99": 0.99}


@query(
    "SELECT event_type, " + ", ".join(f"round(quantile_cont(round(value * 100), {p}), 4) AS {n}" for n, p in _Q.items()) + " FROM events GROUP BY 1"
)
def quantiles_by_key(spark, sf_dir):
    """The route for groups too large for one task, forced by a low row bound."""
    found = exact_quantiles(I.events(spark, sf_dir), ["event_type"], "v", _Q, direct_rows=1)
    return found.select("event_type", *[F.round(c, 4).alias(c) for c in _Q])


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _CORR for b in _CORR
    )
)
def corr_matrix(spark, sf_dir):
    return P.corr_matrix(I.table(spark, sf_dir, "lineitem"), _CORR).withColumn("corr", F.round("corr", 6))


_ACF_LAGS = 168


def _acf(spark, sf_dir):
    filled = I.hourly_filled(spark, sf_dir)
    return correlogram.autocorrelation(filled, ["event_type"], "ts", "v", _ACF_LAGS, HOUR)


_ACF_SQL = (
    f"WITH {I.HOURLY_FILLED}, o AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i, "
    "v - avg(v) OVER (PARTITION BY event_type) AS x, count(v) OVER (PARTITION BY event_type) AS n FROM hfill), "
    f"k AS (SELECT CAST(unnest(range(0, {_ACF_LAGS + 1})) AS INTEGER) AS lag), "
    "s AS (SELECT a.event_type, k.lag, sum(a.x * b.x) AS s, any_value(a.n) AS n FROM o a, k, o b "
    "WHERE b.event_type = a.event_type AND b.i = a.i + k.lag GROUP BY 1, 2), "
    "r AS (SELECT event_type, lag, s / first_value(s) OVER (PARTITION BY event_type ORDER BY lag) AS acf, n FROM s), "
    "c AS (SELECT *, coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (PARTITION BY event_type ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sq FROM r) "
)


@query(
    _ACF_SQL
    + f"SELECT event_type, lag, round(acf, 6) + 0.0 AS acf, round(CASE WHEN lag = 0 THEN 0 ELSE {correlogram.Z_95} * sqrt((1 + 2 * sq) / n) END, 6) AS band FROM c"
)
def acf(spark, sf_dir):
    table = _acf(spark, sf_dir)
    return table.select(
        "event_type", "lag", (F.round("acf", 6) + F.lit(0.0)).alias("acf"), F.round(F.col("upper") - F.col("acf"), 6).alias("band")
    )


@query(
    _ACF_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", l AS (SELECT event_type, list(acf ORDER BY lag) AS r, any_value(n) AS n FROM c GROUP BY 1), "
    "dl AS (SELECT event_type, r, n, 1 AS lag, [r[2]] AS phi, 1 - r[2] * r[2] AS err, r[2] AS refl FROM l UNION ALL "
    "SELECT event_type, r, n, lag + 1, list_append(list_transform(range(1, lag + 1), lambda i: phi[i] - g * phi[lag + 1 - i]), g), err * (1 - g * g), g "
    "FROM (SELECT *, (r[lag + 2] - list_sum(list_transform(range(1, lag + 1), lambda i: phi[i] * r[lag + 2 - i]))) / err AS g FROM dl WHERE lag + 1 < len(r))) "
    f"SELECT event_type, CAST(lag AS INTEGER) AS lag, round(refl, 6) + 0.0 AS pacf, round({correlogram.Z_95} / sqrt(n), 6) AS band FROM dl "
    "UNION ALL SELECT event_type, 0, 1.0, 0.0 FROM l"
)
def pacf(spark, sf_dir):
    table = correlogram.partial_autocorrelation(_acf(spark, sf_dir), ["event_type"])
    return table.select("event_type", "lag", (F.round("pacf", 6) + F.lit(0.0)).alias("pacf"), F.round(F.col("upper") - F.col("pacf"), 6).alias("band"))


@query(
    f"WITH {I.INTERVALS} SELECT min(least(y, a, lower)) - 2 AS y_min, max(greatest(y, a, lower)) + 2 AS y_max FROM iv "
    "WHERE ts BETWEEN TIMESTAMP '1998-01-05' AND TIMESTAMP '1998-01-12'"
)
def zoom_bounds(spark, sf_dir):
    start, end = F.expr("timestamp_ntz'1998-01-05'"), F.expr("timestamp_ntz'1998-01-12'")
    window = filters.closed_range(I.intervals(spark, sf_dir), "ts", start, end)
    return P.value_bounds(window, ["y", "a", "lower"])
