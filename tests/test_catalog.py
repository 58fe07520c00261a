"""Every registered query with SQL gives the same rows as the SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, duck

FOLDER = os.environ.get("TABULON_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_rows_as_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert compare(got, con.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.columns == ["time_bucket", "l_returnflag", "mean_l_extendedprice", "n_records"] and out.count() > 0


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
