import datetime as dt
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tidemill.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_ui_showConsoleProgress="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def hours(n: int, start: str = "2024-01-01 00:00") -> list[dt.datetime]:
    return [at(start) + dt.timedelta(hours=i) for i in range(n)]


@pytest.fixture
def hourly(spark):
    """Build (k, ts, v) from `{key: [values]}`, one value per hour."""

    def build(series: dict):
        rows = [(k, t, None if v is None else float(v)) for k, values in series.items() for t, v in zip(hours(len(values)), values)]
        return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")

    return build


def values(df, col="v", order=("k", "ts")):
    return [r[0] for r in df.orderBy(*order).select(col).collect()]
