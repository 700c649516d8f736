"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewave.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(row):
    return tuple(None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    a = sorted(map(plain, ours.select(columns).collect()), key=str)
    b = sorted(map(plain, theirs.select(", ".join(columns)).fetchall()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-6 for p, q in zip(x, y, strict=True)), (x, y)
