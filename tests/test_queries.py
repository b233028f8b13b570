"""Every query with SQL gives the same rows in DuckDB on the smallest tables, if those are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    got = order([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()])
    res = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = order([tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall()])
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
