import datetime
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalar
from tidewater.operators import aggregates, changelog, joins, keyed, patterns, windows
from tidewater.plans import catalog, sql
from tidewater.sources import connectors, sinks

T0 = datetime.datetime(2024, 1, 1)
SECOND = datetime.timedelta(seconds=1)


def test_skip_strategies():
    """Matches of b+ c in b1 b2 b3 c under each strategy."""
    kinds = ["b", "b", "b", "c"]
    every = [[0, 1, 2, 3], [1, 2, 3], [2, 3]]
    want = {"NO_SKIP": every, "SKIP_TO_NEXT": every, "SKIP_TO_FIRST": every, "SKIP_PAST_LAST_EVENT": every[:1], "SKIP_TO_LAST": [every[0], every[2]]}
    assert {s: patterns.one_or_more_then(kinds, "b", "c", s) for s in patterns.STRATEGIES} == want
    assert patterns.one_or_more_then(["c", "b", "x", "b", "c"], "b", "c", "SKIP_TO_LAST") == [[3, 4]]
    with pytest.raises(ValueError):
        patterns.one_or_more_then(kinds, "b", "c", "NEVER")


def alerts(rows, small, large, timeout):
    up, due, out = False, [], []
    for i, at, value in rows:
        while due and due[0] <= at:
            due.pop(0)
            up = False
        if up and value > large:
            out.append(i)
        if value < small:
            up = True
            due.append(at + timeout)
    return out


def test_alerts_equal_a_timer_simulation(spark):
    rnd = random.Random(4)
    rows, want = [], []
    for user in range(60):
        at, own = 0, []
        for k in range(40):
            at += rnd.choice((1, 2, 5, 10, 11, 30))
            own.append((user * 100 + k, at, rnd.choice((0.5, 50.0, 99.0))))
        want += alerts(own, 1, 95, 10)
        rows += [(user, i, T0 + at * SECOND, v) for i, at, v in own]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, value double")
    got = keyed.small_then_large(df, "user_id", 1, 95, 10_000_000)
    assert sorted(r.event_id for r in got.collect()) == sorted(want) and want


def test_as_of_takes_the_latest_started(spark):
    history = spark.createDataFrame([("a", T0, "x"), ("a", T0 + 10 * SECOND, "y"), ("b", T0 + 5 * SECOND, "z")], "k string, since timestamp, task string")
    rows = spark.createDataFrame([("a", T0 - SECOND, 1), ("a", T0, 2), ("a", T0 + 9 * SECOND, 3), ("a", T0 + 10 * SECOND, 4), ("b", T0, 5), (None, T0, 6)], "k string, ts timestamp, id int")
    got = joins.as_of(rows, history, "k", "ts", "since").select("id", "task").collect()
    assert sorted(map(tuple, got)) == [(2, "x"), (3, "x"), (4, "y")]


def test_interval_bounds(spark):
    left = spark.createDataFrame([(1, T0, "l")], "k int, ts timestamp, v string")
    right = spark.createDataFrame([(1, T0 + d * SECOND, d) for d in (-3, -2, 0, 7, 8)], "k int, ts timestamp, v int")
    closed = joins.interval_join(left, right, "k", "-2 SECONDS", "7 SECONDS")
    assert sorted(r.r_v for r in closed.collect()) == [-2, 0, 7]
    opened = joins.interval_join(left, right, "k", "-2 SECONDS", "7 SECONDS", open_lower=True)
    assert sorted(r.r_v for r in opened.collect()) == [0, 7]


def test_interval_join_over_slots(spark):
    """Against plain loops, with a hot key, ties on slot bounds and times before 1970."""
    rnd = random.Random(2)
    left = [(rnd.choice((1, 1, 1, 2, None)), T0 + rnd.randint(-60, 60) * SECOND, i) for i in range(150)]
    right = [(rnd.choice((1, 1, 2, 3, None)), T0 + rnd.randint(-60, 60) * SECOND, i) for i in range(150)]
    back = datetime.timedelta(days=25000)
    left, right = left + [(1, t - back, 1000 + i) for _, t, i in left], right + [(1, t - back, 1000 + i) for _, t, i in right]
    frames = [spark.createDataFrame(r, "k int, ts timestamp, v int") for r in (left, right)]
    for lower, upper, opened in ((-2, 7, False), (-5, -5, False), (3, 9, True)):
        got = joins.interval_join(*frames, "k", f"{lower} SECONDS", f"{upper} seconds", opened)
        want = [(i, j) for k, t, i in left for m, u, j in right if k is not None and k == m and t + lower * SECOND <= u <= t + upper * SECOND and not (opened and u == t + lower * SECOND)]
        assert sorted((r.l_v, r.r_v) for r in got.collect()) == sorted(want)


def test_as_of_over_slots(spark):
    rnd = random.Random(3)
    history = [(k, T0 + s * SECOND, f"{k}{s}") for k in "ab" for s in rnd.sample(range(0, 900, 3), 12)]
    rows = [(rnd.choice("abc"), T0 + rnd.randint(-10, 1000) * SECOND, i) for i in range(400)]
    got = joins.as_of(spark.createDataFrame(rows, "k string, ts timestamp, id int"), spark.createDataFrame(history, "k string, since timestamp, task string"), "k", "ts", "since", slot_s=60)
    want = [(i, max((s, x) for m, s, x in history if m == k and s <= t)[1]) for k, t, i in rows if any(m == k and s <= t for m, s, _ in history)]
    assert sorted((r.id, r.task) for r in got.collect()) == sorted(want)


def test_lateness_and_batches_over_slots(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice(("a", "a", "a", "b", None)), T0 + (k // 2 + rnd.randint(-90, 5)) * SECOND) for k in range(500)]
    df = spark.createDataFrame(rows, "arrival long, behavior string, ts timestamp")
    small = windows.running_max_before(df, "behavior", "arrival", F.unix_micros("ts"), "high", slot=7)
    whole = windows.running_max_before(df, "behavior", "arrival", F.unix_micros("ts"), "high")
    high, want = {}, {}
    for k, b, t in rows:
        want[k] = high.get(b)
        high[b] = max(high.get(b, t), t)
    micro = lambda t: None if t is None else round(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    for got in (small, whole):
        assert {r.arrival: r.high for r in got.collect()} == {k: micro(t) for k, t in want.items()}
    numbered = [keyed.count_batches(df, "behavior", "arrival", 9, slot).collect() for slot in (11, 100_000)]
    assert sorted(map(str, numbered[0])) == sorted(map(str, numbered[1])) and len(numbered[0]) == 500
    assert all(r.batch_no == sum(b == r.behavior and k < r.arrival for k, b, _ in rows) // 9 for r in numbered[0])


def test_followed_by_is_linear(spark):
    """Two hundred thousand rows of one key."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") % 1000 == 999).alias("hit"))
    began = time.perf_counter()
    got = patterns.followed_by(df, "k", "id", 3, F.col("hit"), "end").agg(F.count("end"), F.sum("end")).first()
    assert time.perf_counter() - began < 15  # about 2 s; evaluating each frame anew takes many minutes
    ends = [next((e for e in range(i + 3 + (999 - (i + 3)) % 1000, 200_000, 1000)), None) for i in range(200_000)]
    ends = [e for e in ends if e is not None]
    assert tuple(got) == (len(ends), sum(ends))


def test_chosen_statistic_in_any_case(spark):
    df = spark.createDataFrame([(m, v) for m in ("sum", "COUNT", "Min", "max", "other") for v in (3, 1, 2)], "m string, v long")
    got = df.groupBy("m").agg(aggregates.chosen_statistic(F.col("m"), F.col("v")).alias("s")).collect()
    assert {r.m: r.s for r in got} == {"sum": 6, "COUNT": 3, "Min": 1, "max": 3, "other": None}


def test_dynamic_windows_start_at_the_command(spark):
    df = spark.createDataFrame([(T0 + 95 * SECOND, 60, 1704067210)], "ts timestamp, size long, start long")
    r = windows.dynamic(df, "size", "start").first()
    assert (r.window_start_s, r.window_end_s) == (1704067270, 1704067330)


def test_fixed_rate_at_the_borders_of_slots(spark, tmp_path):
    """The slots of the query's SQL, which rounds to milliseconds and divides towards zero."""
    border = T0 + 1800 * SECOND
    early = datetime.datetime(1970, 1, 1)
    micros = [-1_800_000_000, -1000, -501, -500, -499, -1, 0, 1, 499, 500]
    times = [at + datetime.timedelta(microseconds=us) for at in (border, early, early - 1800 * SECOND) for us in micros] + [None]
    rows = [(k, at, 1, "view", 1.0, '{"k": 1}') for k, at in enumerate(times)]
    con = duckdb.connect()
    con.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    got = catalog.queries()["q26_tps_fixed_carry"](spark, str(tmp_path)).select("behavior", "slot", "cnt", "carried", "rate").collect()
    want = con.sql(catalog.oracle_sql()["q26_tps_fixed_carry"]).project("behavior, slot, cnt, carried, rate").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_change_records(spark):
    good = '{"db":"d","table":"t","operator_type":"d","pos":3,"before":{"id":"1","x":null},"after":null}'
    rows = spark.createDataFrame([(good,), ("{broken",), ('{"historyRecord":"create"}',), (None,)], "raw string")
    out = changelog.decode(rows, "raw")
    image, deleted = changelog.payload(F.col("operator_type"), F.col("before"), F.col("after"))
    assert [tuple(r) for r in out.select("pos", image.alias("i"), deleted.alias("d")).collect()] == [(3, {"id": "1"}, 1)]
    line = changelog.load_line([F.lit(1), F.lit(None).cast("string")])
    assert rows.limit(1).select(line.alias("l")).first().l == "1\x01\\N"


def test_target_table_text():
    got = changelog.create_table([("id", "bigint", ""), ("note", "TEXT", "it's")], "db.t", "id", "c", 3, 2)
    assert got == "CREATE TABLE IF NOT EXISTS `db.t` (\n  `id` bigint,\n  `note` string COMMENT 'it''s'\n) PRIMARY KEY (`id`)\nCOMMENT 'c'\nDISTRIBUTED BY HASH (`id`) BUCKETS 3\nPROPERTIES ('replication_num' = '2')"


def test_scalar_functions(spark):
    text = ["2024-01-02 03:04:05.678", "2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024/01/02", " ", "never", None]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    got = [r.p for r in df.select(scalar.parse(F.col("t")).cast("timestamp_ntz").alias("p")).collect()]
    whole = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [whole.replace(microsecond=678000), whole, whole, datetime.datetime(2024, 1, 2), None, None, None]
    one = spark.range(1)
    row = one.select(scalar.format_millis(F.lit(1000), "yyyy-MM-dd HH:mm:ss"), scalar.pad_code(F.lit(12345678901), 10), scalar.local_to_millis(F.lit("1970-01-01 08:00:01").cast("timestamp"))).first()
    assert tuple(row) == ("1970-01-01 00:00:01", "12345678901", 1000)


def test_scripts(spark):
    script = "-- hourly; counts\nCREATE OR REPLACE TEMPORARY VIEW big AS SELECT * FROM t WHERE n > 1;\nSELECT count(*) AS c, max(';') AS s FROM big WHERE n < :top;"
    assert len(sql.statements(script)) == 2
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    assert tuple(sql.run_script(spark, script, {"t": df}, top=3).first()) == (1, ";")


def test_generated_rows_are_the_same_again(spark):
    a = connectors.generated(spark, 50).collect()
    assert a == connectors.generated(spark, 50).collect() and len({r.word for r in a}) > 5
    assert all(len(r.code) == 3 and 0 <= r.amount < 100 for r in a)


def test_bulk_load_checks_the_reply(spark):
    import http.server
    import threading

    seen, replies = [], ["Fail", "Success", "Success"]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_PUT(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.headers["label"], body))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(('{"Status": "%s"}' % replies[min(len(seen) - 1, 2)]).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "line string").coalesce(1)
    sinks.bulk_load(f"http://127.0.0.1:{server.server_port}/load", "job", "line", "u", "p", max_rows=2)(df, 7)
    server.shutdown()
    assert [label for label, _ in seen] == ["job-7-0-0", "job-7-0-0", "job-7-0-1"]
    assert [body for _, body in seen[1:]] == [b"a\x02b", b"c"]
