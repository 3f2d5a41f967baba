"""The flagship query: an irregular event stream to a weekday-by-hour profile of its features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import inputs as I
from tidemill.catalog.registry import registry
from tidemill.functions.calendar import with_calendar
from tidemill.functions.timecols import HOUR
from tidemill.operators.features import lag_and_rolling

QUERIES, ORACLES, query = registry()


@query(
    f"WITH {I.HOURLY_FILLED}, lagged AS (SELECT event_type, ts, v, lag(v, 24) OVER w AS v_lag_24, "
    "CASE WHEN count(v) OVER p = 24 THEN avg(v) OVER p END AS v_mean_24 FROM hfill "
    "WINDOW w AS (PARTITION BY event_type ORDER BY ts), "
    "p AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) "
    "SELECT event_type, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n_rows, "
    "round(avg(v), 4) AS mean_v, round(avg(v_lag_24), 4) AS mean_lag_24, round(avg(v_mean_24), 4) AS mean_past_day "
    "FROM lagged GROUP BY 1, 2, 3"
)
def weekday_hour_profile(spark, sf_dir):
    filled = I.hourly_filled(spark, sf_dir)
    features = lag_and_rolling(with_calendar(filled, "ts"), ["event_type"], "ts", "v", [24], [24], HOUR)
    return features.groupBy("event_type", "weekday", "hour").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("v"), 4).alias("mean_v"),
        F.round(F.avg("v_lag_24"), 4).alias("mean_lag_24"),
        F.round(F.avg("v_mean_24"), 4).alias("mean_past_day"),
    )
