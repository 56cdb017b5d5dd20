"""Every query with SQL against that SQL, row by row."""

import datetime
import math

import duckdb
import pytest

from tidewater.plans import catalog

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    rel = con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(v) for v in r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    assert got == want
    assert got
