"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from wattframe.llm.oracles import all_oracles
from wattframe.llm.queries import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def value(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got = all_queries()[name](spark, SF)
    want = con.execute(all_oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(value(r[c]) for c in columns) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(map(value, r)) for r in want.fetchall())
