"""The queries: each applies one operator to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates as agg
from ..operators import changelog, joins, keyed, patterns, windows
from ..session import log, naive, table
from .catalog import query

DAY_US = 86_400_000_000

# ---- top-N and ranking


@query("""
, s AS (SELECT time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes' * i + INTERVAL '1 hour' AS window_end, item_id
        FROM e, (SELECT unnest(generate_series(0, 11)) AS i) WHERE behavior = 'view'),
c AS (SELECT window_end, item_id, count(*) AS cnt FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY cnt DESC, item_id) AS rnk FROM c)
SELECT window_end, item_id, cnt, CAST(rnk AS INTEGER) AS rnk FROM r WHERE rnk <= 5
""")
def q01_hot_items(spark: SparkSession, d: str) -> DataFrame:
    """The five items most viewed in each hour, every five minutes."""
    views = windows.sliding(log(spark, d).where("behavior = 'view'"), "1 hour", "5 minutes")
    counts = views.groupBy("window_end", "item_id").agg(F.count("*").alias("cnt"))
    top = windows.top_n(counts, ["window_end"], [F.desc("cnt"), F.asc("item_id")], 5)
    return top.select(naive("window_end"), "item_id", "cnt", "rnk")


@query("""
, c AS (SELECT CAST(ts AS DATE) AS day, item_id, count(*) AS cnt FROM e WHERE behavior = 'view' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY cnt DESC, item_id) AS rnk FROM c)
SELECT day, string_agg('NO' || rnk || ': item=' || item_id || ' views=' || cnt, chr(10) ORDER BY rnk) AS ranking FROM r WHERE rnk <= 3 GROUP BY day
""")
def q02_ranking_text(spark: SparkSession, d: str) -> DataFrame:
    counts = log(spark, d).where("behavior = 'view'").groupBy(F.to_date("ts").alias("day"), "item_id").agg(F.count("*").alias("cnt"))
    top = windows.top_n(counts, ["day"], [F.desc("cnt"), F.asc("item_id")], 3)
    line = F.format_string("NO%d: item=%d views=%d", "rnk", "item_id", "cnt")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rnk", line.alias("line")))), lambda r: r["line"])
    return top.groupBy("day").agg(F.array_join(rows, "\n").alias("ranking"))


# ---- filters, projections, functions


@query("SELECT event_id, user_id, item_id FROM e WHERE behavior = 'purchase'")
def q03_filter_equals(spark, d):
    return log(spark, d).where(F.col("behavior") == "purchase").select("event_id", "user_id", "item_id")


@query("SELECT event_id, behavior FROM e WHERE contains(behavior, 'ick')")
def q04_filter_contains(spark, d):
    return log(spark, d).where(F.col("behavior").contains("ick")).select("event_id", "behavior")


@query("SELECT event_id, user_id FROM e WHERE length(CAST(user_id AS VARCHAR)) BETWEEN 1 AND 2 AND ts >= TIMESTAMP '2024-01-20'")
def q05_filter_id_length_recent(spark, d):
    user = F.col("user_id").cast("string")
    recent = F.col("ts") >= F.lit("2024-01-20").cast("timestamp")
    return log(spark, d).where(F.length(user).between(1, 2) & recent).select("event_id", "user_id")


@query("""
, j AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE '{"item":' || item_id || '}' END AS raw FROM e)
SELECT event_id, CAST(CASE WHEN raw = 'bad' THEN 1 ELSE CAST(json_extract_string(raw, '$.item') AS BIGINT) END AS BIGINT) AS item FROM j
""")
def q06_json_parse_default(spark, d):
    """Malformed records become a default row."""
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("bad")).otherwise(F.concat(F.lit('{"item":'), F.col("item_id").cast("string"), F.lit("}")))
    parsed = F.from_json(raw, "item long")
    return log(spark, d).select("event_id", F.coalesce(parsed["item"], F.lit(1)).cast("long").alias("item"))


@query("""
, j AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE '{"item":' || item_id || '}' END AS raw FROM e)
SELECT event_id, CAST(json_extract_string(raw, '$.item') AS BIGINT) AS item FROM j WHERE raw <> 'bad'
""")
def q07_json_drop_malformed(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("bad")).otherwise(F.concat(F.lit('{"item":'), F.col("item_id").cast("string"), F.lit("}")))
    return log(spark, d).select("event_id", F.from_json(raw, "item long")["item"].alias("item")).where("item is not null")


@query("SELECT concat_ws(',', user_id, item_id, category_id, behavior, strftime(ts, '%Y-%m-%d %H:%M:%S')) AS line FROM e")
def q08_csv_passthrough(spark, d):
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    return log(spark, d).select(F.to_csv(F.struct("user_id", "item_id", "category_id", "behavior", ts)).alias("line"))


@query("SELECT event_id, unnest(json_keys(props)) AS k FROM events")
def q09_explode_keys(spark, d):
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.explode(F.map_keys(props)).alias("k"))


@query("""
SELECT event_id, CAST(month(ts) - 1 AS INTEGER) AS month0, CAST(day(ts) AS INTEGER) AS dom, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow,
       date_trunc('day', ts) AS midnight, ts + INTERVAL 3 DAY AS later, strftime(ts, '%Y-%m-%d %H:00') AS hour_text,
       CAST(trunc((epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(ts) // 1000) / 86400000.0) AS BIGINT) AS days_left,
       strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch_us(ts) // 1000000 % 600 AS BIGINT) AS sec_in_window FROM e
""")
def q10_date_functions(spark, d):
    ts = F.col("ts")
    return log(spark, d).select(
        "event_id",
        scalar.month0(ts).alias("month0"),
        F.dayofmonth(ts).alias("dom"),
        F.dayofweek(ts).alias("dow"),
        scalar.zero_date(ts).cast("timestamp_ntz").alias("midnight"),
        scalar.plus_days(ts, 3).cast("timestamp_ntz").alias("later"),
        F.date_format(ts, "yyyy-MM-dd HH:00").alias("hour_text"),
        scalar.days_between(ts, F.lit("2024-02-01").cast("timestamp")).alias("days_left"),
        scalar.iso_seconds(F.unix_seconds(ts)).alias("iso"),
        F.pmod(F.unix_seconds(ts), F.lit(600)).alias("sec_in_window"),
    )


@query("SELECT event_id, lpad(CAST(item_id AS VARCHAR), 10, '0') AS code10, lpad(CAST(item_id AS VARCHAR), 3, '0') AS code3, substr(behavior, 1, 3) AS head, string_split(behavior, 'e')[1] AS part FROM e")
def q11_string_functions(spark, d):
    item = F.col("item_id")
    return log(spark, d).select("event_id", scalar.pad_code(item, 10).alias("code10"), scalar.pad_code(item, 3).alias("code3"), F.substring("behavior", 1, 3).alias("head"), F.split("behavior", "e")[0].alias("part"))


@query("""
, t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE 'unknown' END AS txt, ts FROM e)
SELECT event_id, CASE WHEN txt = 'unknown' THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM t
""")
def q12_parse_timestamps(spark, d):
    ts = F.col("ts")
    text = F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).when(F.col("event_id") % 4 == 2, scalar.iso_seconds(F.unix_seconds(ts))).otherwise(F.lit("unknown"))
    return log(spark, d).select("event_id", scalar.parse(text).cast("timestamp_ntz").alias("parsed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey // (l_linenumber + 1) AS shifted FROM lineitem")
def q13_integer_division(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey div (l_linenumber + 1)").alias("shifted"))


# ---- aggregates


@query("SELECT strftime(ts, '%Y-%m-%d %H:00') AS dt, count(*) AS pv, count(DISTINCT user_id) AS uv FROM e GROUP BY 1")
def q14_hourly_pv_uv(spark, d):
    return agg.pv_uv(log(spark, d), [F.date_format("ts", "yyyy-MM-dd HH:00").alias("dt")], "user_id")


@query("SELECT item_id, category_id, behavior, max(ts) AS max_tx, min(ts) AS min_tx, count(behavior) AS coun FROM e GROUP BY 1, 2, 3")
def q15_upsert_group(spark, d):
    return log(spark, d).groupBy("item_id", "category_id", "behavior").agg(F.max("ts").cast("timestamp_ntz").alias("max_tx"), F.min("ts").cast("timestamp_ntz").alias("min_tx"), F.count("behavior").alias("coun"))


@query("SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, behavior, count(*) AS cnt FROM e GROUP BY 1, 2")
def q16_tumble_group(spark, d):
    return windows.tumbling(log(spark, d), "1 minute").groupBy(naive("window_start"), "behavior").agg(F.count("*").alias("cnt"))


@query("""
, b AS (SELECT unnest(['view', 'purchase', 'click', 'error']) AS behavior), w AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM e)
SELECT w.day, b.behavior, count(e.event_id) AS cnt FROM w CROSS JOIN b LEFT JOIN e ON date_trunc('day', e.ts) = w.day AND e.behavior = b.behavior GROUP BY 1, 2
""")
def q17_behavior_day_counts(spark, d):
    day = F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("day")
    return agg.conditional_counts(log(spark, d), [day], "behavior", ["view", "purchase", "click", "error"])


@query("SELECT event_id, user_id, max(behavior) OVER w AS top, count(*) OVER w AS cnt, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def q18_running_max_count_sum(spark, d):
    rows = agg.running(log(spark, d), "user_id", "event_id", top=F.max("behavior"), cnt=F.count("*"), total=F.sum(agg.cents()))
    return rows.select("event_id", "user_id", "top", "cnt", "total")


@query("""
, a AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS amt, CAST(ts AS DATE) AS day FROM e)
SELECT day, user_id, min_by(event_id, event_id) AS first_id, max_by(event_id, event_id) AS last_id, CAST(sum(amt) AS BIGINT) AS total, string_agg(CAST(amt AS VARCHAR), '|' ORDER BY event_id) AS joined FROM a GROUP BY 1, 2
""")
def q19_first_last_reduce(spark, d):
    rows = log(spark, d).withColumn("day", F.to_date("ts"))
    out = agg.first_last(rows.withColumn("id_", F.col("event_id")), ["day", "user_id"], "event_id", "id_", agg.cents())
    return out


@query("SELECT CAST(ts AS DATE) AS day, item_id, count(*) AS pv, count(DISTINCT user_id) AS uv FROM e GROUP BY 1, 2")
def q20_word_pv_uv_day(spark, d):
    return agg.pv_uv(log(spark, d), [F.to_date("ts").alias("day"), "item_id"], "user_id")


@query("SELECT behavior, count(DISTINCT user_id) AS n_users, min(CASE WHEN value > 50 THEN event_id END) AS first_big, count(*) FILTER (WHERE value > 50) AS n_big FROM e GROUP BY 1")
def q21_distinct_and_conditional(spark, d):
    big = F.col("value") > 50
    return log(spark, d).groupBy("behavior").agg(F.countDistinct("user_id").alias("n_users"), F.min(F.when(big, F.col("event_id"))).alias("first_big"), F.count_if(big).alias("n_big"))


# ---- windows


@query("SELECT time_bucket(INTERVAL '1 day', ts, INTERVAL '-8 hours') AS window_start, count(*) AS pv, count(DISTINCT user_id) AS uv FROM e GROUP BY 1")
def q22_day_window_utc8(spark, d):
    return agg.pv_uv(windows.tumbling(log(spark, d), "1 day", "-8 hours"), [naive("window_start")], "user_id")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*) AS cnt, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM e GROUP BY 1")
def q23_tumble_collect(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return windows.tumbling(log(spark, d), "10 minutes").groupBy(naive("window_start")).agg(F.count("*").alias("cnt"), ids.alias("ids"))


@query("""
, t AS (SELECT date_trunc('day', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS tick, user_id FROM e),
k AS (SELECT DISTINCT window_start, tick FROM t)
SELECT k.window_start, k.tick, count(*) AS pv, count(DISTINCT t.user_id) AS uv FROM k JOIN t ON t.window_start = k.window_start AND t.tick <= k.tick GROUP BY 1, 2
""")
def q24_early_fire_cumulative(spark, d):
    hour = F.date_trunc("HOUR", "ts") + F.expr("INTERVAL 1 HOUR")
    out = windows.early_firings(log(spark, d), F.date_trunc("DAY", "ts"), hour, "user_id")
    return out.select(naive("window_start"), naive("tick"), "pv", "uv")


@query("""
, s AS (SELECT time_bucket(INTERVAL '10 seconds', ts) - INTERVAL '10 seconds' * i + INTERVAL '60 seconds' AS window_end FROM e, (SELECT unnest(generate_series(0, 5)) AS i))
SELECT window_end, count(*) AS cnt, CAST(count(*) AS DOUBLE) / CAST(60 AS DOUBLE) AS tps FROM s GROUP BY 1
""")
def q25_tps_shifted(spark, d):
    rows = windows.sliding(log(spark, d), "60 seconds", "10 seconds").groupBy(naive("window_end")).agg(F.count("*").alias("cnt"))
    return rows.withColumn("tps", F.col("cnt") / F.lit(60.0))


@query("""
, c AS (SELECT behavior, epoch_ms(ts) // 1800000 AS slot, count(*) AS cnt FROM e GROUP BY 1, 2)
SELECT behavior, slot, cnt, coalesce(CASE WHEN lag(slot) OVER w = slot - 1 THEN lag(cnt) OVER w ELSE 0 END, 0) AS carried, CAST(cnt AS DOUBLE) / CAST(1800 AS DOUBLE) AS rate FROM c WINDOW w AS (PARTITION BY behavior ORDER BY slot)
""")
def q26_tps_fixed_carry(spark, d):
    return windows.fixed_rate(log(spark, d), 1800, "behavior")


COMMANDS = [
    ("task1", "view", "sum", 72_000, 1704067200),
    ("task2", "click", "COUNT", 3_600, 1704067200),
    ("task3", "view", "max", 108_000, 1704931200),
    ("task4", "purchase", "min", 216_000, 1705276800),
]
_COMMANDS_SQL = ", ".join(f"('{t}', '{a}', '{m}', {s}, {b})" for t, a, m, s, b in COMMANDS)


def _commands(spark):
    return spark.createDataFrame(COMMANDS, "task string, attr string, method string, size_s long, start_s long")


@query(f"""
, cmd(task, attr, method, size_s, start_s) AS (VALUES {_COMMANDS_SQL}),
h AS (SELECT *, lead(start_s) OVER (PARTITION BY attr ORDER BY start_s) AS until_s FROM cmd),
m AS (SELECT e.*, h.*, epoch_ms(ts) // 1000 AS s, CAST(round(value * 100) AS BIGINT) AS amt FROM e JOIN h ON e.behavior = h.attr AND ts >= to_timestamp(start_s) AT TIME ZONE 'UTC' AND (until_s IS NULL OR ts < to_timestamp(until_s) AT TIME ZONE 'UTC')),
w AS (SELECT task, attr, method, CAST(start_s + (s - start_s) // size_s * size_s AS BIGINT) AS window_start_s, size_s, amt FROM m)
SELECT task, attr, window_start_s, CAST(window_start_s + size_s AS BIGINT) AS window_end_s,
       CAST(CASE lower(max(method)) WHEN 'sum' THEN sum(amt) WHEN 'count' THEN count(amt) WHEN 'min' THEN min(amt) ELSE max(amt) END AS BIGINT) AS stat
FROM w GROUP BY task, attr, window_start_s, size_s
""")
def q27_dynamic_window_stats(spark, d):
    """Statistic and window chosen by the command in force for each row's attribute."""
    rows = log(spark, d).select(F.col("behavior").alias("attr"), "ts", agg.cents().alias("amt"))
    history = _commands(spark).withColumn("since", F.timestamp_seconds("start_s"))
    met = windows.dynamic(joins.as_of(rows, history, "attr", "ts", "since"), "size_s", "start_s")
    return met.groupBy("task", "attr", "window_start_s", "window_end_s").agg(agg.chosen_statistic(F.col("method"), F.col("amt")).alias("stat"))


# ---- joins


@query("""
SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey
AND l_shipdate >= o_orderdate - INTERVAL 2 DAY AND l_shipdate <= o_orderdate + INTERVAL 7 DAY
""")
def q28_interval_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("ts"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("n"))
    out = joins.interval_join(o, li, "k", "-2 DAYS", "7 DAYS")
    return out.select(F.col("k").alias("o_orderkey"), F.col("r_n").alias("l_linenumber"), F.col("l_ts").alias("o_orderdate"), F.col("r_ts").alias("l_shipdate"))


@query("""
SELECT o_orderkey, l_linenumber, CAST(round(l_quantity * 100) AS BIGINT) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey
AND l_shipdate > o_orderdate - INTERVAL 2 DAY AND l_shipdate <= o_orderdate + INTERVAL 2 DAY
""")
def q29_purchase_interval_join(spark, d):
    """Order headers and details with the lower bound open."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("ts"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("n"), agg.cents("l_quantity").alias("qty"))
    out = joins.interval_join(o, li, "k", "-2 DAYS", "2 DAYS", open_lower=True)
    return out.select(F.col("k").alias("o_orderkey"), F.col("r_n").alias("l_linenumber"), F.col("r_qty").alias("qty"))


@query("""
, v AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS w FROM e)
SELECT a.w AS window_start, a.item_id, a.event_id AS view_id, b.event_id AS buy_id FROM v a JOIN v b ON a.w = b.w AND a.item_id = b.item_id WHERE a.behavior = 'view' AND b.behavior = 'purchase'
""")
def q30_window_join(spark, d):
    rows = log(spark, d)
    left = rows.where("behavior = 'view'").select("ts", "item_id", F.col("event_id").alias("id"))
    right = rows.where("behavior = 'purchase'").select("ts", "item_id", F.col("event_id").alias("id"))
    return joins.window_join(left, right, "item_id", "1 hour").select(naive("w", "window_start"), "item_id", F.col("l_id").alias("view_id"), F.col("r_id").alias("buy_id"))


@query("""
, c AS (SELECT n_nationkey % 20 AS code, max_by(n_name, n_nationkey) AS name FROM nation GROUP BY 1)
SELECT c_custkey, coalesce(c.name, 'unknown(code=' || c_nationkey || ')') AS label FROM customer LEFT JOIN c ON c_nationkey = c.code
""")
def q31_broadcast_lookup_default(spark, d):
    """Latest configuration per code, with a label for codes that have none."""
    nation = table(spark, d, "nation").select((F.col("n_nationkey") % 20).alias("code"), "n_name", "n_nationkey")
    config = joins.latest_per_key(nation, "code", "n_nationkey")
    miss = F.concat(F.lit("unknown(code="), F.col("c_nationkey").cast("string"), F.lit(")"))
    return joins.lookup(table(spark, d, "customer"), config, "c_nationkey", "code", "n_name", miss, "label").select("c_custkey", "label")


@query("""
SELECT event_id, e.user_id, coalesce(CASE WHEN length(c_name) = 18 THEN c_name END, '00000000000') AS phone FROM e LEFT JOIN customer ON c_custkey = e.user_id
""")
def q32_async_lookup_default(spark, d):
    """Lookup in a dimension with a default for misses and values of the wrong length."""
    dim = table(spark, d, "customer").select("c_custkey", F.when(F.length("c_name") == 18, F.col("c_name")).alias("c_name"))
    return joins.lookup(log(spark, d), dim, "user_id", "c_custkey", "c_name", F.lit("00000000000"), "phone").select("event_id", "user_id", "phone")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def q33_dimension_join(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query(f"""
, cmd(task, attr, method, size_s, start_s) AS (VALUES {_COMMANDS_SQL})
SELECT event_id, max_by(task, start_s) AS task FROM e JOIN cmd ON behavior = attr AND ts >= to_timestamp(start_s) AT TIME ZONE 'UTC' GROUP BY event_id
""")
def q34_as_of_command(spark, d):
    history = _commands(spark).select("attr", "task", F.timestamp_seconds("start_s").alias("since"))
    rows = log(spark, d).select(F.col("behavior").alias("attr"), "ts", "event_id")
    return joins.as_of(rows, history, "attr", "ts", "since").select("event_id", "task")


@query("""
, a AS (SELECT user_id, event_id, ts, behavior FROM e),
t AS (SELECT a.user_id, a.event_id, min(CASE WHEN b.behavior IN ('click', 'purchase') THEN b.ts END) AS active_time, min(CASE WHEN b.behavior = 'error' THEN b.ts END) AS fail_time
      FROM a LEFT JOIN a b ON a.user_id = b.user_id AND b.ts >= a.ts WHERE a.behavior = 'view' GROUP BY 1, 2)
SELECT DISTINCT user_id, active_time, fail_time FROM t WHERE fail_time IS NOT NULL
""")
def q35_clue_followup(spark, d):
    """For each view the first later activity and failure. A running minimum from the last row back
    gives in linear time what the quadratic self-join states."""
    later = Window.partitionBy("user_id").orderBy(F.col("ts").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.min(F.when(F.col("behavior").isin("click", "purchase"), F.col("ts"))).over(later)
    fail = F.min(F.when(F.col("behavior") == "error", F.col("ts"))).over(later)
    rows = log(spark, d).select("user_id", "behavior", active.alias("active_time"), fail.alias("fail_time"))
    return rows.where("behavior = 'view' and fail_time is not null").select("user_id", naive("active_time"), naive("fail_time")).distinct()


@query("""
, a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM e)
SELECT a.day, a.user_id, EXISTS (SELECT 1 FROM a b WHERE b.user_id = a.user_id AND b.day < a.day) AS known FROM a
""")
def q36_semi_anti_history(spark, d):
    """Users of each day, and whether an earlier day had them: the first day is joined back, no history is collected."""
    active = log(spark, d).select("user_id", F.to_date("ts").alias("day")).distinct()
    firsts = active.groupBy("user_id").agg(F.min("day").alias("first_day"))
    return active.join(firsts, "user_id").select("day", "user_id", (F.col("first_day") < F.col("day")).alias("known"))


@query("SELECT 'nation' AS source, n_nationkey AS code, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def q37_union_all(spark, d):
    n = table(spark, d, "nation").select(F.lit("nation").alias("source"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.lit("region").alias("source"), F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"))
    return n.unionByName(r)


@query("""
SELECT 'orders' AS topic, CAST(o_orderkey AS VARCHAR) AS key, count(*) AS cnt FROM orders GROUP BY 1, 2
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), count(*) FROM customer GROUP BY 1, 2
""")
def q38_topic_dispatch(spark, d):
    """Changes of several tables in one stream, each row with the topic it goes to."""
    o = table(spark, d, "orders").select(F.lit("orders").alias("topic"), F.col("o_orderkey").cast("string").alias("key"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("topic"), F.col("c_custkey").cast("string").alias("key"))
    return o.unionByName(c).groupBy("topic", "key").agg(F.count("*").alias("cnt"))


# ---- keyed state


@query(f"""
, t AS (SELECT *, epoch_us(ts) AS us, CASE WHEN value < 5 THEN epoch_us(ts) END AS s FROM e),
m AS (SELECT *, CASE WHEN s IS NOT NULL THEN min(s) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW) END AS smin FROM t),
f AS (SELECT *, last_value(smin IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS flag FROM m)
SELECT event_id, user_id, ts FROM f WHERE value > 95 AND flag + {DAY_US} > us
""")
def q39_fraud_alerts(spark, d):
    return keyed.small_then_large(log(spark, d), "user_id", 5, 95, DAY_US).select("event_id", "user_id", naive("ts"))


@query("""
, b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS batch_no FROM e)
SELECT user_id, batch_no, count(*) AS cnt, string_agg(category_id || '-' || item_id, ',' ORDER BY event_id) AS items FROM b GROUP BY 1, 2
""")
def q40_count_batches(spark, d):
    rows = keyed.count_batches(log(spark, d), "user_id", "event_id", 10)
    pair = F.concat_ws("-", F.col("category_id").cast("string"), F.col("item_id").cast("string"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("event_id", pair.alias("p")))), lambda r: r["p"])
    return rows.groupBy("user_id", "batch_no").agg(F.count("*").alias("cnt"), F.array_join(items, ",").alias("items"))


@query("""
, p AS (SELECT event_id, user_id, behavior, lag(behavior) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM e)
SELECT event_id, user_id, previous, behavior FROM p WHERE previous <> behavior
""")
def q41_key_changes(spark, d):
    return keyed.changes(log(spark, d), "user_id", "event_id", "behavior").select("event_id", "user_id", "previous", "behavior")


_LATE_SQL = """
, a AS (SELECT *, event_id * 10 + CASE WHEN event_id % 50 = 0 THEN 405 ELSE 0 END AS arrival, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end FROM e),
w AS (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY behavior ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60000000 AS wm FROM a),
l AS (SELECT *, coalesce(epoch_us(window_end) - 1000 + 60000000 <= wm, false) AS late FROM w)
"""


def _arrivals(spark, d):
    """Events where every fiftieth arrives forty rows late."""
    rows = log(spark, d).withColumn("arrival", F.col("event_id") * 10 + F.when(F.col("event_id") % 50 == 0, 405).otherwise(0))
    return windows.lateness(rows, "behavior", "arrival", "10 minutes", 60, 60)


@query(_LATE_SQL + "SELECT event_id, behavior, window_end FROM l WHERE late")
def q42_late_rows(spark, d):
    return _arrivals(spark, d).where("late").select("event_id", "behavior", naive("window_end"))


@query(_LATE_SQL + "SELECT behavior, window_end, count(*) AS cnt FROM l WHERE NOT late GROUP BY 1, 2")
def q43_on_time_counts(spark, d):
    return _arrivals(spark, d).where("not late").groupBy("behavior", naive("window_end")).agg(F.count("*").alias("cnt"))


@query("""
, a AS (SELECT DISTINCT user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM e),
f AS (SELECT user_id, min(day) AS first_day FROM a GROUP BY 1), k AS (SELECT DISTINCT day FROM a),
x AS (SELECT k.day, (SELECT count(*) FROM f WHERE first_day < k.day) AS known, (SELECT count(*) FROM f WHERE first_day = k.day - 1) AS last_new,
       (SELECT count(*) FROM f WHERE first_day = k.day) AS cur_new, (SELECT count(*) FROM f JOIN a ON a.user_id = f.user_id AND a.day = k.day WHERE first_day = k.day - 1) AS kept FROM k)
SELECT *, CASE WHEN last_new > 0 THEN CAST(kept AS DOUBLE) / last_new ELSE CAST(0 AS DOUBLE) END AS ratio FROM x
""")
def q44_retention(spark, d):
    return agg.retention(log(spark, d), "user_id", F.to_date(F.col("ts") + F.expr("INTERVAL 8 HOURS")))


# ---- patterns


@query("""
, p AS (SELECT user_id, event_id AS id1, behavior AS b1, lead(event_id) OVER w AS id2, lead(behavior) OVER w AS b2, lead(event_id, 2) OVER w AS id3, lead(behavior, 2) OVER w AS b3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, id1, id2, id3 FROM p WHERE b1 = 'view' AND b2 = 'view' AND b3 = 'click'
""")
def q45_cep_strict(spark, d):
    is_ = lambda k, v: lambda at: at("behavior", k) == v
    found = patterns.strict(log(spark, d), "user_id", "event_id", [is_(1, "view"), is_(2, "view"), is_(3, "click")], ["event_id", "behavior"])
    return found.select("user_id", *[F.col(f"event_id_{k}").alias(f"id{k}") for k in (1, 2, 3)])


@query("""
, p AS (SELECT user_id, event_id AS id1, behavior AS b1, value AS v1, lead(value) OVER w AS v2, lead(value, 2) OVER w AS v3,
               min(CASE WHEN behavior = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, id1, end_id FROM p WHERE b1 = 'signup' AND v2 > 50 AND v3 > v1 AND end_id IS NOT NULL
""")
def q46_cep_start_middle_end(spark, d):
    """start, next a large value, next a value above the start's, followed by the first error after them."""
    rows = patterns.followed_by(log(spark, d), "user_id", "event_id", 3, F.col("behavior") == "error", "end_id")
    conditions = [lambda at: at("behavior", 1) == "signup", lambda at: at("value", 2) > 50, lambda at: at("value", 3) > at("value", 1), lambda at: at("end_id", 1).isNotNull()]
    found = patterns.strict(rows, "user_id", "event_id", conditions, ["event_id", "behavior", "value", "end_id"])
    return found.select("user_id", F.col("event_id_1").alias("id1"), F.col("end_id_1").alias("end_id"))


@query("""
, p AS (SELECT user_id, event_id AS id1, value AS v1, ts, lead(event_id) OVER w AS id2, lead(value) OVER w AS v2, lead(ts) OVER w AS ts2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, id1, id2, CAST(round(v2 * 100) AS BIGINT) - CAST(round(v1 * 100) AS BIGINT) AS rise FROM p WHERE v2 > v1 AND ts2 <= ts + INTERVAL 3 HOUR
""")
def q47_cep_rising_pair(spark, d):
    conditions = [lambda at: F.lit(True), lambda at: (at("value", 2) > at("value", 1)) & (at("ts", 2) <= at("ts", 1) + F.expr("INTERVAL 3 HOURS"))]
    found = patterns.strict(log(spark, d), "user_id", "event_id", conditions, ["event_id", "value", "ts"])
    return found.select("user_id", F.col("event_id_1").alias("id1"), F.col("event_id_2").alias("id2"), (agg.cents("value_2") - agg.cents("value_1")).alias("rise"))


def _skip_sql(where: str) -> str:
    return f"""
, o AS (SELECT user_id, event_id, behavior, count(*) FILTER (WHERE behavior <> 'view') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM e),
r AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS k, max(CASE WHEN behavior = 'click' THEN event_id END) OVER (PARTITION BY user_id, run) AS last_id FROM o)
SELECT user_id AS key, event_id AS first_id, last_id, n - k + 1 AS n FROM r WHERE behavior = 'view' AND last_id IS NOT NULL AND {where}
"""


@query(_skip_sql("true"))
def q48_cep_no_skip(spark, d):
    return patterns.repeated_then(log(spark, d), "user_id", "event_id", "behavior", "view", "click", "NO_SKIP")


@query(_skip_sql("k = 1"))
def q49_cep_skip_past_last(spark, d):
    return patterns.repeated_then(log(spark, d), "user_id", "event_id", "behavior", "view", "click", "SKIP_PAST_LAST_EVENT")


@query(_skip_sql("(k = 1 OR k = n - 1)"))
def q50_cep_skip_to_last(spark, d):
    return patterns.repeated_then(log(spark, d), "user_id", "event_id", "behavior", "view", "click", "SKIP_TO_LAST")


# ---- change logs

_OP = "CASE behavior WHEN 'signup' THEN 'c' WHEN 'purchase' THEN 'u' WHEN 'error' THEN 'd' ELSE 'r' END"


def _changes(spark, d):
    """Events as change records in JSON, decoded again."""
    rows = log(spark, d)
    op = F.expr(_OP)
    image = F.create_map(F.lit("id"), F.col("item_id").cast("string"), F.lit("user"), F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")))
    record = F.to_json(F.struct(F.lit("shop").alias("db"), F.concat(F.lit("t"), F.col("category_id").cast("string")).alias("table"), op.alias("operator_type"), F.col("event_id").alias("pos"), F.when(op.isin("u", "d"), image).alias("before"), F.when(op != "d", image).alias("after")))
    return changelog.decode(rows.select(record.alias("raw")), "raw").drop("raw")


@query(f"SELECT event_id AS pos, 't' || category_id AS tbl, CAST(item_id AS VARCHAR) AS id, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS usr, CASE WHEN {_OP} = 'd' THEN 1 ELSE 0 END AS deleted FROM e")
def q51_cdc_upsert_payload(spark, d):
    image, deleted = changelog.payload(F.col("operator_type"), F.col("before"), F.col("after"))
    rows = _changes(spark, d).select("pos", F.col("table").alias("tbl"), image.alias("i"), deleted.alias("deleted"))
    return rows.select("pos", "tbl", F.col("i")["id"].alias("id"), F.try_element_at("i", F.lit("user")).alias("usr"), "deleted")


@query(f"""
, c AS (SELECT item_id, event_id, user_id, {_OP} AS op, row_number() OVER (PARTITION BY item_id ORDER BY event_id DESC) AS k FROM e)
SELECT item_id, event_id, user_id FROM c WHERE k = 1 AND op <> 'd'
""")
def q52_cdc_latest_state(spark, d):
    rows = log(spark, d).withColumn("pos", F.col("event_id"))
    return changelog.latest_state(rows, "item_id", F.expr(_OP), ["event_id", "user_id"], "pos")


@query("""
, b AS (SELECT category_id, event_id, (row_number() OVER (PARTITION BY category_id ORDER BY event_id) - 1) // 100 AS batch_no FROM e)
SELECT category_id, batch_no, count(*) AS cnt, min(event_id) AS first_id, max(event_id) AS last_id FROM b GROUP BY 1, 2
""")
def q53_cdc_table_batches(spark, d):
    rows = keyed.count_batches(log(spark, d), "category_id", "event_id", 100)
    return rows.groupBy("category_id", "batch_no").agg(F.count("*").alias("cnt"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(f"SELECT event_id, concat_ws(chr(1), item_id, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '\\N' END, CASE WHEN {_OP} = 'd' THEN 1 ELSE 0 END) AS line FROM e")
def q54_cdc_load_lines(spark, d):
    user = F.when(F.col("event_id") % 5 != 0, F.col("user_id"))
    deleted = F.when(F.expr(_OP) == "d", 1).otherwise(0)
    return log(spark, d).select("event_id", changelog.load_line([F.col("item_id"), user, deleted]).alias("line"))


@query("""
, c AS (SELECT n_regionkey, n_nationkey, n_name FROM nation)
SELECT r_name AS tbl, string_agg('`' || lower(n_name) || '` string', ', ' ORDER BY n_nationkey) AS cols FROM region LEFT JOIN c ON n_regionkey = r_regionkey GROUP BY r_name
""")
def q55_ddl_columns(spark, d):
    """Column lists of target tables from a catalog-shaped join (tables left join columns)."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    column = F.concat(F.lit("`"), F.lower("n_name"), F.lit("` string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", column.alias("c")))), lambda x: x["c"])
    return r.join(n, r.r_regionkey == n.n_regionkey, "left").groupBy(F.col("r_name").alias("tbl")).agg(F.array_join(rows, ", ").alias("cols"))


@query("SELECT event_id, user_id FROM e ORDER BY event_id LIMIT 1000")
def q56_limit(spark, d):
    return log(spark, d).select("event_id", "user_id").orderBy("event_id").limit(1000)


@query("""
, p AS (SELECT item_id, event_id, value, lag(value) OVER (PARTITION BY item_id ORDER BY event_id) AS prev FROM e)
SELECT item_id, event_id, CAST(round(value * 100) AS BIGINT) - CAST(round(prev * 100) AS BIGINT) AS move FROM p WHERE abs(value - prev) > 50
""")
def q57_price_fluctuation(spark, d):
    """Rows that move by more than 50 against the row before of the same item."""
    rows = log(spark, d).withColumn("prev", F.lag("value").over(Window.partitionBy("item_id").orderBy("event_id")))
    return rows.where(F.abs(F.col("value") - F.col("prev")) > 50).select("item_id", "event_id", (agg.cents() - agg.cents("prev")).alias("move"))


@query("SELECT category_id, count(*) AS cnt, count(DISTINCT item_id) AS n_items FROM e GROUP BY 1 HAVING count(*) > 10")
def q58_keyed_stream_counts(spark, d):
    """One shuffle serves both the key's state and its aggregate."""
    return log(spark, d).groupBy("category_id").agg(F.count("*").alias("cnt"), F.countDistinct("item_id").alias("n_items")).where("cnt > 10")
