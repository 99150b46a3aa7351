"""Every query with a statement against DuckDB, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tonequarry.plans import queries as plans
from tonequarry.plans.standins import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, datetime.datetime):
        return v.date().isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, str):
        return v
    return round(float(v), 5) + 0.0


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine = plans.QUERIES[name](spark, SF)
    theirs = duck.sql(plans.ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine.columns, mine.collect()) == rows_of(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).columns


def test_entry(spark):
    assert plans.entry(spark, SF).count() > 0
