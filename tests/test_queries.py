"""Every registered query of the timeline operators against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from cuesheet import plans

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value:.5f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select(*(f"`{c}`" for c in columns)).collect())
    if name not in SQL:
        assert rows
        return
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    want = sorted(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in result.fetchall())
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or abs(float(x) - float(y)) < 2e-5
