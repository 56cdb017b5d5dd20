import http.server
import threading

import pytest
from pyspark.sql import functions as F

from tidewater.operators import joins, keyed
from tidewater.session import behaviour
from tidewater.sources import connectors, sinks
from tidewater.streaming import jobs, processors

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    """Events in four files, replayed one file per micro-batch in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    events = spark.read.parquet(f"{DIR}/events.parquet")
    n = events.count()
    for k in range(4):
        events.where((F.col("event_id") >= k * n // 4) & (F.col("event_id") < (k + 1) * n // 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    yield behaviour(connectors.replay(spark, str(tmp_path / "in"), events.schema))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def batch(spark):
    return behaviour(spark.read.parquet(f"{DIR}/events.parquet"))


def test_windowed_counts_equal_batch(spark, stream, tmp_path):
    jobs.run_available(jobs.windowed_counts(stream, "1 day", "1 hour", ["behavior"]), str(tmp_path / "c"), "counts", mode="update")
    got = spark.table("counts").groupBy("window_start", "behavior").agg(F.max("cnt").alias("cnt"))
    want = batch(spark).groupBy(F.window("ts", "1 day")["start"].alias("window_start"), "behavior").agg(F.count("*").alias("cnt"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_interval_join_equals_batch(spark, stream, tmp_path):
    side = lambda df, b: df.where(F.col("behavior") == b).select("user_id", "ts", F.col("event_id").alias("id"))
    out = jobs.interval_join(side(stream, "view"), side(stream, "purchase"), "user_id", "-2 HOURS", "7 HOURS", "1 day")
    jobs.run_available(out, str(tmp_path / "c"), "joined")
    want = joins.interval_join(side(batch(spark), "view"), side(batch(spark), "purchase"), "user_id", "-2 HOURS", "7 HOURS")
    assert sorted(map(tuple, spark.table("joined").select("l_id", "r_id").collect())) == sorted(map(tuple, want.select("l_id", "r_id").collect()))


def test_fraud_processor_equals_batch(spark, stream, tmp_path):
    day = 86_400_000
    p = processors.SmallThenLarge(10, 90, day)
    out = stream.groupBy("user_id").transformWithState(p, p.OUTPUT, "Update", "None")
    jobs.run_available(out, str(tmp_path / "c"), "alerts", mode="update")
    rows = batch(spark).withColumn("ts", F.timestamp_millis(F.unix_millis("ts")))
    want = keyed.small_then_large(rows, "user_id", 10, 90, day * 1000)
    assert sorted(r.event_id for r in spark.table("alerts").collect()) == sorted(r.event_id for r in want.collect())


def test_count_or_time_loses_nothing(spark, stream, tmp_path):
    p = processors.CountOrTime(5, 86_400_000)
    out = stream.withWatermark("ts", "1 second").groupBy("user_id").transformWithState(p, p.OUTPUT, "Append", "EventTime")
    jobs.run_available(out, str(tmp_path / "c"), "batches")
    rows = spark.table("batches").collect()
    ids = [int(i) for r in rows for i in r.ids.split(",")]
    assert len(ids) == len(set(ids)) and {r.by for r in rows} == {"count", "time"}
    assert all(r.n == 5 if r.by == "count" else r.n < 5 for r in rows)


def test_late_router(spark, stream, tmp_path):
    p = processors.LateRouter(600_000, 60_000)
    rows = stream.withColumn("arrival", F.col("event_id") * 10 + F.when(F.col("event_id") % 50 == 0, 405).otherwise(0))
    out = rows.groupBy("behavior").transformWithState(p, p.OUTPUT, "Update", "None")
    jobs.run_available(out, str(tmp_path / "c"), "routed", mode="update")
    got = spark.table("routed")
    assert got.count() == batch(spark).count() and 0 < got.where("late").count() < got.count() / 10


def test_first_seen(spark, stream, tmp_path):
    p = processors.FirstSeen(3_600_000)
    out = stream.select("behavior", F.col("item_id").alias("value")).groupBy("behavior").transformWithState(p, p.OUTPUT, "Update", "ProcessingTime")
    want = batch(spark).select("behavior", "item_id").distinct().count()
    query = out.writeStream.outputMode("update").format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).start()
    try:  # processing-time state keeps the query running, so it is stopped by what it has
        for _ in range(120):
            if spark.table("firsts").count() >= want:
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert spark.table("firsts").count() == want


def test_upsert_and_topics(spark, stream, tmp_path):
    path = str(tmp_path / "state")
    query = jobs.run_available(stream.select("item_id", "event_id", "user_id"), str(tmp_path / "c"), foreach=sinks.upsert(path, ["item_id"], "event_id"))
    last = query.lastProgress["batchId"] if query.lastProgress else 3
    while not (tmp_path / "state" / f"generation={last}").exists():
        last -= 1
    got = sinks.upserted(spark, path, last)
    want = joins.latest_per_key(batch(spark).select("item_id", "event_id", "user_id"), "item_id", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sinks.write_topics(batch(spark).select("behavior", "event_id"), "behavior", str(tmp_path / "topics"))
    assert spark.read.text(str(tmp_path / "topics")).select("topic").distinct().count() == batch(spark).select("behavior").distinct().count()
    sinks.write_days(spark.createDataFrame([("20240102030405", 1), ("x", 2)], "date string, n int"), "date", str(tmp_path / "days"))
    assert {str(r.day) for r in spark.read.json(str(tmp_path / "days")).collect()} == {"20240102", "19790101"}


def test_http_polling(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"hello")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(connectors.HttpPolling)
    df = spark.readStream.format("http_polling").option("url", f"http://127.0.0.1:{server.server_port}/").option("interval", "0").load()
    query = df.writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(100):
            if spark.table("polled").count() >= 2:
                break
            query.awaitTermination(0.3)
    finally:
        query.stop()
        server.shutdown()
    assert {r.body for r in spark.table("polled").collect()} == {"hello"}


def test_broker_options():
    o = connectors.BrokerOptions("h:1", topic="t", startup="specific-offsets", offsets="partition:0,offset:42;partition:1,offset:300")
    assert o.options()["startingOffsets"] == '{"t": {"0": 42, "1": 300}}'
    assert connectors.BrokerOptions("h:1", pattern="t.*", startup="EARLIEST").options()["startingOffsets"] == "earliest"
    for bad in (dict(), dict(topic="t", startup="never"), dict(topic="t", startup="timestamp"), dict(topic="t", startup="specific-offsets", offsets="partition:x")):
        with pytest.raises(ValueError):
            connectors.BrokerOptions("h:1", **bad).options()


def test_connected_streams_and_refreshed_dimension(spark, stream, tmp_path):
    rows = batch(spark)
    config = rows.where("behavior = 'signup'").select("user_id", "ts", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("value"))
    config.coalesce(1).write.parquet(str(tmp_path / "config"))
    side = connectors.replay(spark, str(tmp_path / "config"), config.schema)
    both = jobs.connected(stream.where("behavior = 'view'").select("user_id", "event_id", "ts"), side, "user_id", "value")
    p = processors.LatestConfig("none")
    jobs.run_available(both.groupBy("user_id").transformWithState(p, p.OUTPUT, "Update", "None"), str(tmp_path / "c1"), "configured", mode="update")
    assert spark.table("configured").count() == rows.where("behavior = 'view'").count()
    sink = sinks.once(str(tmp_path / "looked"))
    dim = lambda s: s.read.parquet(f"{DIR}/customer.parquet")
    write = jobs.refreshed_lookup(dim, "user_id", "c_custkey", "c_name", "0000", "name", sink)
    jobs.run_available(stream.select("event_id", "user_id"), str(tmp_path / "c2"), foreach=write)
    assert spark.read.parquet(str(tmp_path / "looked")).count() == rows.count()
