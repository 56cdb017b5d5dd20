import hashlib

from tidewater.llm import warc


def expected(rows):
    first = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if len(b) >= warc.MIN_REVISIT:
            first.setdefault(b, []).append(page)
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        ids = first.get(b, [])
        low = min((i for i in ids if i is not None), default=None)
        revisit = len(ids) > 1 and low is not None and low != page
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://www.B.example.org:80/x?y#z", "a" * 100),
    (1, "http://b.example.org/x?y", "a" * 100),
    (2, None, "a" * 99),
    (4, "https://c.example.org", "a" * 99),
    (5, "http://d.example.org?q=ü\n", None),
    (6, "", ""),
    (7, "x", "é\r\n\r\n" * 40000),
    (7, "x", "é\r\n\r\n" * 40000),
    (8, "x", "é\r\n\r\n" * 40000),
    (None, "x", "q" * 500),
    (None, "x", "q" * 500),
]


def test_records_and_lookups(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int").repartition(3)
    directory = warc.write_index(warc.write_archives(df, archive_bytes=200), block=2)
    assert directory.count() <= 4 and sum(r.n for r in directory.collect()) == len(ROWS)
    got = warc.read_archives(warc.look_up(directory, df))
    assert sorted(map(tuple, got.drop("url").collect()), key=str) == expected(ROWS)
    assert {(r.page_id, r.url) for r in got.collect()} == {(p, u or None) for p, u, _ in ROWS}
    look = warc.Captures.of(directory)
    found = look.find("https://b.example.org/x?y")
    assert sorted(h["WARC-Type"] for h, _ in found) == ["response", "revisit"]
    assert len(look.find("x")) == 5
    assert look.find("http://nowhere.example") == []
    some = spark.createDataFrame([(7, "x"), (4, "x"), (None, "x"), (2, None), (3, "http://b.example.org/x?y")], "page_id long, url string")
    assert sorted(map(str, (r.page_id for r in warc.look_up(directory, some).collect()))) == ["2", "3", "7", "7", "None", "None"]
    assert warc.surt("http://u:p@www.A.b.example.org:81?k") == "org,example,b,a)/?k"


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    directory = warc.write_index(warc.write_archives(df))
    assert warc.read_archives(warc.look_up(directory, df)).collect() == []
    assert warc.Captures.of(directory).find("x") == []


def test_entries_that_fill_many_blocks(spark):
    rows = [(k % 3 if k % 7 else None, "http://one.example/", f"text {k}") for k in range(200)] + [(k, f"http://h{k % 9}.example/{k}", "") for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    directory = warc.write_index(warc.write_archives(df), block=5)
    assert sorted(map(tuple, warc.read_archives(warc.look_up(directory, df)).drop("url").collect()), key=str) == expected(rows)
    look = warc.Captures.of(directory)
    assert len(look.find("http://one.example/")) == 200
    assert all(len(look.find(u)) == 1 for _, u, _ in rows[200:230])


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op7_warc(spark, sf).collect()), key=str) == expected(rows)
