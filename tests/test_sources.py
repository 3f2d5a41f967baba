"""Readers, writers and source checks."""

import os
import subprocess
import sys

from conftest import ROOT, at
from pyspark.sql import functions as F

from tidemill.session import scratch_path, shared_dir
from tidemill.sources import tables as S


def test_csv_roundtrip_with_spaces_in_names(spark, tmp_path):
    df = spark.createDataFrame([(at("2024-01-01 00:30"), 1.5), (at("2024-01-01 01:00"), None)], "time timestamp_ntz, `power [kW]` double")
    S.write_csv(df, str(tmp_path / "c"))
    back = S.scan_csv(spark, str(tmp_path / "c"), "time timestamp_ntz, `power [kW]` double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_series_key_from_file_name(spark, tmp_path):
    for name, value in (("Apt1_2014", 1.0), ("Apt2_2015", 2.0)):
        (tmp_path / f"{name}.csv").write_text(f"2014-01-01 00:00:00,{value}\n")
    df = S.scan_csv_by_name(spark, f"{tmp_path}/Apt*.csv", "time string, power double", r"/(Apt\d+)_", "apartment", header=False)
    assert sorted((r.apartment, r.power) for r in df.collect()) == [("Apt1", 1.0), ("Apt2", 2.0)]


def test_sources_without_required_columns_are_left_out(spark):
    good = spark.createDataFrame([(1.0, 2.0)], "power double, temperature double")
    assert list(S.usable_sources({"a": good, "b": good.drop("temperature")}, ["power", "temperature"])) == ["a"]
    assert S.missing_columns(good, ["power", "x"]) == ["x"]


def test_missing_parts(spark):
    df = spark.createDataFrame([("a", 2014), ("a", 2015), ("b", 2015)], "k string, y int")
    assert sorted(map(tuple, S.missing_parts(df, "k", "y", [2014, 2015, 2016]).collect())) == [("a", 2016), ("b", 2014), ("b", 2016)]


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark).rstrip("/"))


def test_filters_and_columns_reach_the_scan(spark):
    path = scratch_path(spark, "pushdown")
    rows = spark.range(10).select("id", F.lit(at("2024-01-01")).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("unused"))
    stored = S.materialise(rows, path)
    from tidemill.operators.filters import day_range

    plan = day_range(stored, "ts", F.lit("2024-01-01"), F.lit("2024-01-02")).select("id", "ts")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "unused" not in text.split("ReadSchema")[1]


def test_a_plain_local_session_has_a_folder(tmp_path):
    """Without any configuration the library stores stages in a folder of its own, and clears what it made."""
    code = (
        "import os; from tidemill.session import build_session, clear_scratch, cut_lineage, shared_dir; "
        "from tidemill.sources.tables import kept; "
        "s = build_session('plain', 'local[2]', spark_ui_enabled='false'); "
        "assert s.conf.get('spark.checkpoint.dir', None) is None; "
        "t = kept(s.range(5), 'x'); assert t.count() == cut_lineage(t).count() == 5; "
        "d = shared_dir(s); assert d == shared_dir(s) and len(os.listdir(d + '/tidemill')) == 1; "
        "assert clear_scratch(s) == 1 and os.listdir(d + '/tidemill') == [] and clear_scratch(s) == 0; print('stored')"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_CONF")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "stored" in done.stdout, done.stderr[-2000:]


def test_queries_without_the_tokenizers(tmp_path):
    """Where what the subpackage llm imports is missing, all other queries are served."""
    code = (
        "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['public_tokenizers'] = None; "
        "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print('served')"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "served" in done.stdout, done.stderr[-2000:]
