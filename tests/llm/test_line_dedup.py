import random
import re
import time

import duckdb
import pytest

from tidewater.llm import line_dedup


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.sql(line_dedup.ORACLE).fetchall())
    got = sorted(map(tuple, line_dedup.op8_line_dedup(spark, sf).collect()))
    assert got == want
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()


def stated(html):
    """The lines as the patterns state them."""
    t = re.sub(line_dedup.DROP, "\n", html, flags=re.A)
    t = re.sub(line_dedup.TAG, "", re.sub(line_dedup.BREAK, "\n", t, flags=re.A))
    return [x.strip(" ") for x in t.split("\n") if x.strip(" ")]


def test_lines_are_those_of_the_patterns():
    rnd = random.Random(6)
    parts = ["<script>", "<SCRIPT a='>'", "</script >", "<style", "</style>", "<!--", "-->", ">", "<", "a b", "\n", " ", "<p>", "</div", "<b>", "scripts", "<scripts>", "<stylé>"]
    for _ in range(30000):
        html = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert line_dedup.lines_of(html) == stated(html), html


@pytest.mark.parametrize("unit", ["<script>", "<script", "<style>x", "<!-- ", "<", "<p", "</script>", "<!--><script ><style>", "<script></script ", "x\n"])
def test_long_pages_take_linear_time(unit):
    html = unit * (5_000_000 // len(unit))
    began = time.perf_counter()
    line_dedup.lines_of(html)
    assert time.perf_counter() - began < 10


def test_boilerplate_per_host(spark):
    rows = [(k, f"http://u@A.example:80/p{k}", f"<nav>menu</nav><p>own {k}</p><p>menu </p><script>menu<p></script><!-- x -->") for k in range(4)]
    rows += [(10, "http://b.example", "menu"), (11, None, None), (11, None, "a\nb  <b>c</b>"), (12, "http://c.example/", "x " * 100000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.text): (r.host, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[(0, "own 0")] == ("a.example", 3, 2)
    assert got[(10, "menu")] == ("b.example", 1, 0)
    assert got[(11, "")] == ("", 0, 0) and got[(11, "a\nb  c")] == ("", 2, 0)
    assert len(got) == 8
    assert line_dedup.drop_boilerplate(df.limit(0)).collect() == []
