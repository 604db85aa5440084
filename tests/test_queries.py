"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from wattframe.checks.oracles import all_oracles
from wattframe.checks.queries import all_queries

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _key(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)


def _rows(rows, names, order):
    at = [names.index(n) for n in order]
    return sorted((tuple(_key(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_as_sql(spark, tables, name):
    got = all_queries()[name](spark, SF)
    want = tables.execute(all_oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    assert _rows(got.collect(), got.columns, order) == _rows(want.fetchall(), columns, order)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_runs(spark, name):
    assert all_queries()[name](spark, SF).count() > 0


def test_every_series_has_a_line(spark):
    got = all_queries()["m12_line_per_series"](spark, SF)
    assert {r.series for r in got.select("series").distinct().collect()} == {r.event_type for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect()}
