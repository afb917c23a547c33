"""Every registered query with SQL returns the rows of its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from skyframe.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows, columns = df.collect(), sorted(df.columns)
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert sorted(tuple(_text(r[c]) for c in columns) for r in rows) == sorted(tuple(_text(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert registry.entry(spark, DATA).count() > 0
