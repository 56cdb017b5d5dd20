"""Queries of this folder against their SQL on a whole table."""

import duckdb
import pytest

from tidewater.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(rel.project(", ".join(df.columns)).fetchall(), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
