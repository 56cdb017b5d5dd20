"""Connectors, sinks, triggers, lookups and streaming jobs that the queries do not reach."""

import datetime
import functools
import io
import json
import random
import sqlite3
import time
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import DIR, batch, stream  # noqa: F401  the fixture
from tidewater import config
from tidewater.operators import aggregates, changelog, joins, patterns, triggers, watermarks
from tidewater.plans import sql
from tidewater.sources import connectors, sinks
from tidewater.streaming import jobs, lookups, processors

T0 = datetime.datetime(2024, 1, 1)
SECOND = datetime.timedelta(seconds=1)

# ---- parameters


def test_parameters(spark):
    text = "# c\n! d\na = 1\nb: x=y\nlong = one\\\n  two\nflag=true\n\n"
    assert config.properties(text) == {"a": "1", "b": "x=y", "long": "one" + "two", "flag": "true"}
    given = config.arguments(["--a", "-5", "--on", "-k", "v"])
    assert given == {"a": "-5", "on": "true", "k": "v"}
    p = config.Parameters.of(config.properties(text), given)
    assert (p.number("a"), p.flag("on"), p.flag("none"), p.number("none", 7), p.required("k")) == (-5, True, False, 7, "v")
    with pytest.raises(KeyError):
        p.required("none")
    with pytest.raises(ValueError):
        config.arguments(["x"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    config.Parameters({"spark.sql.shuffle.partitions": "3", "other": "1"}).apply(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)


# ---- sources


def test_startup_of_readers():
    o = functools.partial(connectors.BrokerOptions, "h:1", topic="t")
    assert o().options()["startingOffsets"] == "latest" and o().options(bounded=True)["startingOffsets"] == "earliest"
    assert o(startup="group-offsets", committed={"0": 5}, group="g").options() | {} == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": '{"t": {"0": 5}}', "kafka.group.id": "g"}
    assert o(startup="timestamp", start_ms=5, end_ms=9).options(True)["endingTimestamp"] == "9"
    for bad in (o(startup="group-offsets"), o(startup="latest")):
        with pytest.raises(ValueError):
            bad.options(bounded=True)
    assert connectors.pulsar_options("pulsar://h", "http://h", "t", subscription="s")["predefinedSubscription"] == "s"
    with pytest.raises(ValueError):
        connectors.pulsar_options("a", "b", "t", start="middle")


def test_broker_records(spark):
    df = spark.createDataFrame([("t", 0, 5, T0, None, b"v")], "topic string, partition int, offset long, timestamp timestamp, key binary, value binary")
    assert tuple(connectors.records(df).first())[:3] == ("t", 0, 5) and tuple(connectors.records(df).first())[4:] == (None, "v")


def test_files_and_jdbc(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "dim.csv").write_text("1|x\n2|y\n")
    assert [r.value for r in connectors.read_text(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    assert [tuple(r) for r in connectors.cached_file(spark, str(tmp_path / "dim.csv"), "k int, v string", "|").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="(?i)driver|jdbc"):  # no driver is there: the reader is reached with its options
        connectors.read_jdbc(spark, "jdbc:none:x", "SELECT 1", ("k", 0, 9, 3))
    with pytest.raises(Exception, match="(?i)driver|jdbc"):
        sinks.jdbc("jdbc:none:x", "t")(spark.range(1), 0)


def test_sampled_rows_come_from_the_table(spark, tmp_path):
    cached = spark.createDataFrame([(k, None if k % 3 else f"v{k}") for k in range(20)], "k int, v string").repartition(3)
    df = connectors.sample_rows(spark, cached, 200, str(tmp_path / "t"), "|")
    query = df.writeStream.format("memory").queryName("sampled").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(100):
            if spark.table("sampled").count() >= 50:
                break
            query.awaitTermination(0.3)
    finally:
        query.stop()
    got = {r.value for r in spark.table("sampled").collect()}
    assert len(got) > 5 and got <= {f"{k}|{'' if k % 3 else f'v{k}'}" for k in range(20)}


def test_replies_are_kept_until_committed(tmp_path, monkeypatch):
    bodies = iter(["one", "two\r\n", "three"])
    monkeypatch.setattr(connectors, "http_get", lambda url, timeout: next(bodies))
    reader = connectors._Polling({"url": "x", "interval": "0", "keep": str(tmp_path / "k")})
    at = reader.initialOffset()
    for _ in range(3):
        _, at = reader.read(at)
    again = connectors._Polling({"url": "x", "interval": "0", "keep": str(tmp_path / "k")})
    assert list(again.readBetweenOffsets({"n": 1}, {"n": 3})) == [(1, "two\r\n"), (2, "three")]
    again.commit({"n": 2})
    assert list(again.readBetweenOffsets({"n": 2}, {"n": 3})) == [(2, "three")] and len(list((tmp_path / "k").iterdir())) == 1
    assert list(connectors._Polling({"url": "x"}).readBetweenOffsets({"n": 0}, {"n": 1})) == []


def test_generated_stream(spark, tmp_path):
    for shape in ("word", "coded", "attributes", "payments", "pairs", "patterns"):
        assert connectors.generated_stream(spark, shape).isStreaming
        assert connectors.generate(spark.range(5), shape).collect() == connectors.generate(spark.range(5), shape).collect()
    with pytest.raises(ValueError):
        connectors.generate(spark.range(1), "other")


# ---- sinks


def test_broker_writer(spark, tmp_path):
    """The same rows and options through a format that is there: files of JSON."""
    rows = sinks.broker_rows(spark.range(4), "t", key=F.col("id"), timestamp=F.timestamp_seconds("id"), partition=sinks.partitioner("custom", 2, F.col("id")))
    assert rows.columns == ["topic", "key", "value", "timestamp", "partition"]
    assert [r.value for r in rows.orderBy("key").collect()] == [f'{{"id":{k}}}' for k in range(4)]
    sinks.broker("h:1", fmt="json", path=str(tmp_path / "out"))  # options are the producer's
    assert sinks.broker_options("h:1", True, linger_ms="5") == {"kafka.bootstrap.servers": "h:1", "kafka.enable.idempotence": "true", "kafka.acks": "all", "kafka.linger_ms": "5"}
    for mode in ("fixed", "round-robin"):
        got = spark.range(100, numPartitions=4).select(sinks.partitioner(mode, 3).alias("p")).distinct().count()
        assert got == 3
    with pytest.raises(ValueError):
        sinks.partitioner("custom", 3)
    with pytest.raises(Exception, match="(?i)kafka"):
        sinks.broker("h:1")(rows, 0)


def test_batches_are_sent_once(spark, tmp_path):
    sent = []
    write = sinks.broker_once(str(tmp_path / "ledger"), lambda b, n: sent.append((n, b.columns, b.count())))
    for n in (0, 1, 0, 1, 2):
        write(spark.range(n + 1), n)
    assert sent == [(0, ["id", "batch"], 1), (1, ["id", "batch"], 2), (2, ["id", "batch"], 3)]


def test_printing(spark, stream, tmp_path):  # noqa: F811
    said = io.StringIO()
    with redirect_stdout(said):
        sinks.printed("p")(spark.createDataFrame([(1, "a")], "n int, s string"), 0)
    assert said.getvalue() == "p> 1, a\n"
    query = sinks.console(stream.select("event_id"), str(tmp_path / "c"), rows=1).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_files_roll_by_bytes(spark, tmp_path):
    df = spark.range(1000).select(F.concat(F.lit("line "), F.lpad(F.col("id").cast("string"), 15, "0")).alias("value")).coalesce(1)
    sinks.write_rolling(df, str(tmp_path / "r"), 2100, F.substring("value", 20, 1))
    files = [p for p in (tmp_path / "r").rglob("part-*")]
    assert len(files) == 10 and max(p.stat().st_size for p in files) <= 2100
    assert spark.read.text(str(tmp_path / "r")).count() == 1000


def test_rows_are_committed_one_by_one(spark, tmp_path):
    path = str(tmp_path / "db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)")
    c.close()
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1)
    sinks.each_row(functools.partial(sqlite3.connect, path), "INSERT INTO t VALUES (?, ?)", ["k", "v"])(df, 0)
    with pytest.raises(Exception, match="UNIQUE"):
        more = spark.createDataFrame([(3, "c"), (1, "again")], "k int, v string").coalesce(1)
        sinks.each_row(functools.partial(sqlite3.connect, path), "INSERT INTO t VALUES (?, ?)", ["k", "v"])(more, 1)
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT * FROM t ORDER BY k").fetchall() == [(1, "a"), (2, "b"), (3, "c")]


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "u")
    write = sinks.upsert(path, ["k"], "pos", buckets=8)
    schema = "k long, pos long, v string, deleted int"
    batches = [[(k, k, f"a{k}", 0) for k in range(40)], [(3, 100, "b", 0), (3, 90, "old", 0), (7, 101, "c", 1)], [(50, 102, "d", 0)]]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), n)
    write(spark.createDataFrame(batches[1], schema), 1)  # a batch that runs again
    want = {k: f"a{k}" for k in range(40) if k != 7} | {3: "b", 50: "d"}
    assert {r.k: r.v for r in sinks.upserted(spark, path, 2, "deleted").collect()} == want
    assert sum(p.name.startswith("bucket=") for p in (tmp_path / "u" / "generation=1").iterdir()) <= 2
    assert sum(p.name.startswith("bucket=") for p in (tmp_path / "u" / "generation=2").iterdir()) == 1
    assert sinks.compact(spark, path, 2) >= 2
    assert {r.k: r.v for r in sinks.upserted(spark, path, 2, "deleted").collect()} == want


def test_loads_by_table_ask_for_columns_once(spark, monkeypatch):
    asked, put = [], []
    monkeypatch.setattr(sinks, "bulk_load", lambda url, job, line, user, password, **o: lambda df, n: put.append((url, job, n, sorted(r.line for r in df.collect()))))
    df = spark.createDataFrame([("a", {"x": "1", "y": None}, 0), ("b", {"z": "3"}, 1)], "tbl string, image map<string,string>, deleted int")
    write = sinks.bulk_load_tables(lambda t: f"u/{t}", "tbl", lambda t: asked.append(t) or {"a": ["x", "y"], "b": ["z"]}[t], "j", "u", "p")
    write(df, 0)
    write(df, 1)
    assert asked == ["a", "b"] and put[:2] == [("u/a", "j-a", 0, ["1\x01\\N\x010"]), ("u/b", "j-b", 0, ["3\x011"])] and len(put) == 4


# ---- scripts


def test_declared_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"user_id":"u1","n":1}\n{"user_id":"u2","n":5}\n')
    script = f"""
    CREATE TABLE src (user_id VARCHAR, n BIGINT) WITH ('connector.type' = 'filesystem', 'format.type' = 'json', 'connector.path' = '{tmp_path}/in');
    CREATE TABLE dst (user_id VARCHAR, n BIGINT, note VARCHAR) WITH ('connector.type' = 'filesystem', 'format.type' = 'csv', 'connector.path' = '{tmp_path}/out');
    INSERT INTO dst (n, user_id) SELECT big.n + 1, big.user_id FROM (SELECT * FROM src WHERE n > 2) big;
    """
    assert [tuple(r) for r in sql.run_script(spark, script).collect()] == [("u2", 6, None)]
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out")).collect()] == [("u2", "6", None)]
    assert [r.value for r in sql.lines(spark.range(1).select("id", F.lit("a,b").alias("s")), "csv").collect()] == ['0,"a,b"']
    with pytest.raises(ValueError):
        sql.run_script(spark, "CREATE TABLE x (a INT) WITH ('connector.type'='nothing'); SELECT * FROM x")
    name, columns, options = sql.declared("CREATE TABLE k (a VARCHAR, ts TIMESTAMP(3), d DECIMAL(10, 2), WATERMARK FOR ts AS ts) WITH ('connector.type'='kafka', 'p'='it''s')")
    assert (name, columns, options) == ("k", "a string, ts timestamp, d DECIMAL(10, 2)", {"connector.type": "kafka", "p": "it's"})


# ---- triggers and watermarks against plain loops


def test_count_or_time_batches(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), at, k) for k, at in enumerate(sorted(rnd.randrange(400) for _ in range(200)))]
    want = []
    for key in "ab":
        held, due = [], None
        for _, at, ident in (r for r in rows if r[0] == key):
            if held and at >= due:
                want.append((key, held[0], held[-1], len(held), "time"))
                held = []
            if not held:
                due = at + 20
            held.append(ident)
            if len(held) == 7:
                want.append((key, held[0], held[-1], 7, "count"))
                held = []
        if held:
            want.append((key, held[0], held[-1], len(held), "time"))
    df = spark.createDataFrame(rows, "key string, at long, id long").repartition(3)
    got = triggers.count_or_time(df, "key", F.col("at"), "id", 7, 20)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[4] for w in want} == {"count", "time"}
    assert triggers.count_or_time(df.limit(0), "key", F.col("at"), "id", 7, 20).collect() == []


def firings(times, size, interval, window):
    """Every instant in turn, as timers would."""
    out, total, new, due, until = [], 0, 0, None, None
    for now in range(0, max(times) + window + 1):
        if due == now and now < (until or 0):
            out.append((until, now, total, new, "time"))
            new, due = 0, None
        if until == now:
            out.append((until, now, total, new, "end"))
            total, new, due, until = 0, 0, None, None
        for _ in range(times.count(now)):
            until = until or now - now % window + window
            total, new = total + 1, new + 1
            if new >= size:
                out.append((until, now, total, new, "count"))
                new, due = 0, None
            elif due is None:
                due = now + interval
    return out


def test_count_and_time_windows(spark):
    rnd = random.Random(2)
    times = {k: sorted(rnd.randrange(600) for _ in range(n)) for k, n in (("a", 150), ("b", 25), ("c", 1))}
    rows = [(k, t, i) for k, own in times.items() for i, t in enumerate(own)]
    got = triggers.count_and_time_windows(spark.createDataFrame(rows, "key string, at long, id long"), "key", F.col("at"), "id", 4, 15, 60)
    want = [(k, *f) for k, own in times.items() for f in firings(own, 4, 15, 60)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[5] for w in want} == {"count", "time", "end"}


def test_count_and_time_on_a_stream(spark, stream, tmp_path):  # noqa: F811
    size, interval, window = 2, 7_200_000, 86_400_000
    p = processors.CountAndTime(size, interval, window)
    rows = batch(spark).select("user_id", "event_id", F.timestamp_millis(F.unix_millis("ts")).alias("ts"))  # in order of time, four files
    cuts = rows.select(F.expr("percentile(unix_micros(ts), array(0.25, 0.5, 0.75))")).first()[0]
    for lo, hi in zip([0, *cuts], [*cuts, 1e18]):
        rows.where((F.unix_micros("ts") >= lo) & (F.unix_micros("ts") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "sorted"))
    stream = connectors.replay(spark, str(tmp_path / "sorted"), rows.schema)
    out = stream.withWatermark("ts", "1 second").groupBy("user_id").transformWithState(p, p.OUTPUT, "Append", "EventTime")
    jobs.run_available(out, str(tmp_path / "c"), "window_firings")
    got = {tuple(r) for r in spark.table("window_firings").collect()}
    rows = batch(spark).withColumn("ms", F.unix_millis("ts"))
    want = triggers.count_and_time_windows(rows, "user_id", F.col("ms"), "event_id", size, interval, window)
    want = {(int(r.key), *tuple(r)[1:]) for r in want.collect()}
    last = max(w[1] for w in want)
    assert got <= want and {w for w in want if w[1] < last} <= got and {g[5] for g in got} == {"count", "time", "end"}


def test_watermarks_of_streams(spark, stream):  # noqa: F811
    for strategy in watermarks.STRATEGIES:
        assert jobs.watermarked(stream, strategy, "5 seconds").isStreaming
    plan = jobs.watermarked(stream, "bounded", "5 seconds")._jdf.queryExecution().analyzed().toString()
    assert "EventTimeWatermark" in plan and "EventTimeWatermark" not in jobs.watermarked(stream, "none")._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        jobs.watermarked(stream, "other")
    with pytest.raises(ValueError):
        watermarks.watermark(batch(spark), "behavior", "event_id", "other", "m")


# ---- streaming jobs


def test_processing_time_and_both_domains(spark, stream, tmp_path):  # noqa: F811
    event, handled = jobs.both_domains(stream, "1 day", "1 hour", ["behavior"])
    jobs.run_available(event, str(tmp_path / "a"), "by_event", mode="update")
    jobs.run_available(handled, str(tmp_path / "b"), "by_handled", mode="update")
    n = batch(spark).count()
    for name in ("by_event", "by_handled"):
        top = spark.table(name).groupBy("window_start", "behavior").agg(F.max("cnt").alias("c"))
        assert top.agg(F.sum("c")).first()[0] == n
    assert abs(spark.table("by_handled").agg(F.max("window_start")).first()[0] - datetime.datetime.now()) < datetime.timedelta(days=3)


def test_refreshed_every_second(spark, stream, tmp_path):  # noqa: F811
    seen = []
    query = jobs.refreshed(stream.groupBy("behavior").agg(F.count("*").alias("cnt")), str(tmp_path / "c"), "1 second", lambda b, n: seen.append({r.behavior: r.cnt for r in b.collect()}))
    want = {r.behavior: r["count"] for r in batch(spark).groupBy("behavior").count().collect()}
    try:
        for _ in range(80):
            if seen and functools.reduce(lambda a, b: a | b, seen) == want:
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert functools.reduce(lambda a, b: a | b, seen) == want and len(seen) >= 2


def test_late_rows_fire_again(spark, stream, tmp_path):  # noqa: F811
    out = jobs.late_updates(stream, "1 day", "0 seconds", "40 days", ["behavior"])
    jobs.run_available(out, str(tmp_path / "c"), "again", mode="update")
    top = spark.table("again").groupBy("window_start", "behavior").agg(F.max("cnt").alias("c"), F.count("*").alias("firings"))
    assert top.agg(F.sum("c")).first()[0] == batch(spark).count()


def test_observed_counts(spark):
    from pyspark.sql import Observation

    seen = Observation("all")
    df = spark.range(2500).observe(seen, F.count("*").alias("rows"))
    assert jobs.counted(df).count() == 2500 and seen.get["rows"] == 2500


def test_distinct_and_top_n_of_streams(spark, stream, tmp_path):  # noqa: F811
    jobs.run_available(jobs.distinct_per_window(stream, "1 day", "1 hour", ["behavior"], "user_id"), str(tmp_path / "a"), "uvs", mode="append")
    want = {(r.d, r.behavior): r.uv for r in aggregates.pv_uv(batch(spark), [F.date_trunc("DAY", "ts").alias("d"), "behavior"], "user_id").collect()}
    got = {(r.window_start, r.behavior): r.uv for r in spark.table("uvs").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 10
    counts = stream.groupBy("item_id").agg(F.count("*").alias("cnt")).withColumn("one", F.lit(1))
    jobs.run_available(counts, str(tmp_path / "b"), mode="update", foreach=jobs.top_n_of_batches(str(tmp_path / "top"), "one", ["cnt", "item_id"], 3))
    assert 0 < spark.read.parquet(str(tmp_path / "top")).where("batch = 0").count() <= 3


def test_reduced_state(spark, stream, tmp_path):  # noqa: F811
    p = processors.Reduced("min")
    jobs.run_available(stream.groupBy("user_id").transformWithState(p, p.OUTPUT, "Update", "None"), str(tmp_path / "c"), "least", mode="update")
    rows = aggregates.running(batch(spark), "user_id", "event_id", low=F.min("value"))
    assert {r.event_id: r.value for r in spark.table("least").collect()} == {r.event_id: r.low for r in rows.collect()}
    with pytest.raises(ValueError):
        processors.Reduced("mean")


def test_users_roll_into_history(spark, stream, tmp_path):  # noqa: F811
    p = processors.DayUsers()
    rows = stream.select((F.col("user_id") % 3).alias("slot"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.col("user_id").alias("user"), "ts")
    out = rows.withWatermark("ts", "0 seconds").groupBy("slot").transformWithState(p, p.OUTPUT, "Append", "EventTime")
    jobs.run_available(out, str(tmp_path / "c"), "rolled")
    got = {r.day: (r.known, r.cur_new) for r in spark.table("rolled").groupBy("day").agg(F.sum("known").alias("known"), F.sum("cur_new").alias("cur_new")).collect()}
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    firsts = [r.d for r in batch(spark).groupBy("user_id").agg(F.min(day).alias("d")).collect()]
    assert got and all(v == (sum(f < d for f in firsts), sum(f == d for f in firsts)) for d, v in got.items() if d < max(got))


def test_pattern_on_a_stream(spark, stream, tmp_path):  # noqa: F811
    for strategy in ("NO_SKIP", "SKIP_PAST_LAST_EVENT"):
        p = processors.RepeatedThen("view", "click", strategy)
        jobs.run_available(stream.groupBy("user_id").transformWithState(p, p.OUTPUT, "Update", "None"), str(tmp_path / strategy), f"matches_{strategy.lower()}", mode="update")
        want = patterns.repeated_then(batch(spark), "user_id", "event_id", "behavior", "view", "click", strategy)
        assert sorted(map(tuple, spark.table(f"matches_{strategy.lower()}").collect())) == sorted(map(tuple, want.collect()))


def test_expiring_alerts_equal_those_that_stay(spark, stream, tmp_path):  # noqa: F811
    out = []
    for expire in (False, True):
        p = processors.SmallThenLarge(10, 90, 86_400_000, expire)
        rows = stream.withWatermark("ts", "0 seconds") if expire else stream
        jobs.run_available(rows.groupBy("user_id").transformWithState(p, p.OUTPUT, "Append" if expire else "Update", "EventTime" if expire else "None"), str(tmp_path / str(expire)), f"alerts_{expire}".lower(), mode="append" if expire else "update")
        out.append(sorted(r.event_id for r in spark.table(f"alerts_{expire}".lower()).collect()))
    assert out[0] == out[1] and out[0]


def test_values_are_forgotten_after_their_time(spark, tmp_path):
    """The same value comes twice, three seconds apart, and is held for one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame([("b", "v")], "behavior string, value string").coalesce(1)
    path = str(tmp_path / "in")
    rows.write.parquet(path)
    df = connectors.replay(spark, path, rows.schema)
    p = processors.FirstSeen(1000)
    out = df.groupBy("behavior").transformWithState(p, p.OUTPUT, "Update", "ProcessingTime")
    query = out.writeStream.outputMode("update").format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for want in (1, 2):
            for _ in range(80):
                if spark.table("forgotten").count() >= want:
                    break
                query.awaitTermination(0.5)
            if want == 1:
                time.sleep(3)
                rows.write.mode("append").parquet(path)
    finally:
        query.stop()
    assert spark.table("forgotten").count() == 2


def _log(spark, path, n=60):
    """A change log with schema history in files, one operation after the other."""
    path.mkdir()
    images = lambda k: {"id": str(k % 5), "name": None if k % 4 == 0 else f"n{k}"}
    records = []
    for k in range(n):
        op = "r" if k < 10 else "cud"[k % 3]
        records.append({"db": "shop", "table": "ab"[k % 2], "operator_type": op, "pos": k, "before": images(k) if op in "ud" else None, "after": None if op == "d" else images(k)})
        if k % 20 == 5:
            records.append({"historyRecord": f"ALTER {k}"})
    for f in range(3):
        part = records[f * len(records) // 3 : (f + 1) * len(records) // 3]
        (path / f"{f}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
    return records


def test_replicated_table(spark, tmp_path):
    records = _log(spark, tmp_path / "log")
    done, loaded = [], []
    raw = connectors.read_changes(spark, str(tmp_path / "log"))
    columns = [("id", "bigint", "key"), ("name", "text", "")]
    jobs.replicate_table(raw, "raw", "a", columns, "id", str(tmp_path / "c"), done.append, lambda b, n: loaded.extend(r.line for r in b.collect()))
    assert len(done) == 1 and done[0].startswith("CREATE TABLE IF NOT EXISTS `a`")
    own = [r for r in records if r.get("table") == "a"]
    image = lambda r: r["before"] if r["operator_type"] == "d" else r["after"]
    want = ["\x01".join([image(r)["id"], image(r)["name"] or "\\N", str(int(r["operator_type"] == "d"))]) for r in own]
    assert sorted(loaded) == sorted(want)
    changes, history = changelog.route(connectors.read_changes(spark, str(tmp_path / "log"), stream=False), "raw")
    assert changes.count() == 60 and sorted(r.history for r in history.collect()) == ["ALTER 25", "ALTER 45", "ALTER 5"]
    with pytest.raises(ValueError):
        changelog.started(changes, "timestamp", F.col("pos"), F.col("operator_type"), start=5)


def test_database_in_batches_of_tables(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _log(spark, tmp_path / "log")
    raw = connectors.read_changes(spark, str(tmp_path / "log"))
    raw = raw.withColumn("ts", F.timestamp_seconds(F.coalesce(F.get_json_object("raw", "$.pos").cast("long"), F.lit(0))))
    jobs.run_available(jobs.table_batches(raw, "raw", "0 seconds", size=8, wait_ms=12_000), str(tmp_path / "c"), "table_batches")
    rows = spark.table("table_batches").collect()
    ids = [int(i) for r in rows for i in r.ids.split(",")]
    assert len(ids) == len(set(ids)) and len(ids) >= 45 and {r.tbl for r in rows} == {"shop.a", "shop.b"}
    assert all(len({int(i) % 2 for i in r.ids.split(",")}) == 1 for r in rows) and all(r.n <= 8 for r in rows)


# ---- lookups


def test_slow_store_times_out_and_is_bounded(spark):
    df = spark.createDataFrame([(k % 7 if k % 5 else None,) for k in range(40)], "k long").coalesce(1)
    began = time.perf_counter()
    slow = lookups.looked_up(df, "k", lambda: lookups.Pause(3), "v", seconds=0.2, capacity=10).collect()
    assert {r.v for r in slow} == {"timeout", "nothing"} and time.perf_counter() - began < 30
    fast = lookups.looked_up(df, "k", lambda: lookups.Pause(0.01), "v", seconds=5, capacity=3).collect()
    assert all(r.v == ("nothing" if r.k is None else str(r.k)) for r in fast) and len(fast) == 40


def test_lookup_on_a_stream(spark, stream, tmp_path):  # noqa: F811
    out = lookups.looked_up(stream.select("event_id", "user_id"), "user_id", lambda: lookups.Pause(0), "v")
    jobs.run_available(out, str(tmp_path / "c"), "asked")
    assert spark.table("asked").where("v = cast(user_id as string)").count() == batch(spark).count()


def test_dimension_misses_get_the_default(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    dim = spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    got = joins.lookup(df, dim, "k", "k", "v", F.lit("none"), "found").select("k", "found")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "x"), (2, "none"), (None, "none")]
