"""Registered queries against their SQL forms, and the driver contract."""

import pytest
from conftest import ROOT, SF

import sys

sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry_module
from check_oracles import compare, connect

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_sql_forms_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()) == ""


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
