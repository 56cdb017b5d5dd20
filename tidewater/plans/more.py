"""More queries: firings, watermarks, change logs, sinks and lookups in batch form over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import changelog, patterns, triggers, watermarks, windows
from ..session import log, naive, table
from ..sources import connectors, sinks
from ..streaming import lookups
from .batch import _LATE_SQL, _arrivals, _skip_sql
from .catalog import query

# ---- firings


@query(_LATE_SQL + """
, f AS (SELECT *, NOT late AND coalesce(epoch_us(window_end) - 1000 <= wm, false) AS refire FROM l),
o AS (SELECT behavior, window_end, count(*) AS cnt FROM f WHERE NOT late AND NOT refire GROUP BY 1, 2),
z AS (SELECT f.behavior, f.window_end, f.event_id, coalesce(o.cnt, 0) + row_number() OVER (PARTITION BY f.behavior, f.window_end ORDER BY arrival) AS cnt
      FROM f LEFT JOIN o ON o.behavior = f.behavior AND o.window_end = f.window_end WHERE refire)
SELECT behavior, window_end, CAST(NULL AS BIGINT) AS event_id, cnt FROM o UNION ALL SELECT behavior, window_end, event_id, cnt FROM z
""")
def q59_allowed_lateness_firings(spark, d):
    """Each window at its end, and once more for every late row that is still allowed."""
    return windows.firings(_arrivals(spark, d), "behavior", "arrival", "event_id").select("behavior", naive("window_end"), "event_id", "cnt")


_MARKS_SQL = """
, a AS (SELECT event_id, behavior, epoch_us(ts) AS us, event_id * 10 + CASE WHEN event_id % 50 = 0 THEN 405 ELSE 0 END AS arrival FROM e),
m AS (SELECT *, max(us) OVER (PARTITION BY behavior ORDER BY arrival) AS high FROM a),
t AS (SELECT behavior, arrival // 1000 AS tick, max(high) AS top FROM m GROUP BY 1, 2),
p AS (SELECT behavior, tick, max(top) OVER (PARTITION BY behavior ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM t)
"""


def _in_arrival(spark, d):
    return log(spark, d).withColumn("arrival", F.col("event_id") * 10 + F.when(F.col("event_id") % 50 == 0, 405).otherwise(0))


@query(_MARKS_SQL + """
SELECT m.event_id, high - 1000 AS ascending, high - 60001000 AS bounded, high AS punctuated, us - 1000 AS latest, top - 2000000 AS periodic, us + 3600000000 - 1000 AS reassigned
FROM m JOIN p ON p.behavior = m.behavior AND p.tick = m.arrival // 1000
""")
def q60_watermark_strategies(spark, d):
    """The watermark right after each row, under each strategy."""
    rows = _in_arrival(spark, d)
    for strategy, name, delay in (("ascending", "ascending", 0), ("bounded", "bounded", 60_000_000), ("punctuated", "punctuated", 0), ("current", "latest", 0), ("periodic", "periodic", 2_000_000)):
        rows = watermarks.watermark(rows, "behavior", "arrival", strategy, name, delay, tick=1000)
    again = watermarks.reassigned(rows, F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    again = watermarks.watermark(again, "behavior", "arrival", "current", "reassigned")
    return again.select("event_id", "ascending", "bounded", "punctuated", "latest", "periodic", "reassigned")


@query("""
, a AS (SELECT user_id, epoch_us(ts) AS us, event_id * 10 + CASE WHEN event_id % 50 = 0 THEN 405 ELSE 0 END AS arrival FROM e),
m AS (SELECT *, max(us) OVER (PARTITION BY user_id ORDER BY arrival) AS high FROM a),
s AS (SELECT user_id, arrival // 2000 AS step, max(high) AS mark FROM m GROUP BY 1, 2),
w AS (SELECT *, lead(step) OVER (PARTITION BY user_id ORDER BY step) AS nxt FROM s),
g AS (SELECT DISTINCT step FROM s)
SELECT g.step, min(w.mark) AS mark FROM g LEFT JOIN w ON w.step <= g.step AND g.step < least(coalesce(w.nxt, w.step + 3), w.step + 3) GROUP BY 1
""")
def q61_watermark_with_idle_sources(spark, d):
    """The least watermark of the sources (users) that are not idle: a source without rows for three steps is."""
    rows = watermarks.watermark(_in_arrival(spark, d), "user_id", "arrival", "punctuated", "mark")
    steps = rows.groupBy("user_id", F.floor(F.col("arrival") / 2000).alias("step")).agg(F.max("mark").alias("mark"))
    return watermarks.with_idle(steps, "user_id", "step", "mark", 3)


@query("""
, a AS (SELECT behavior, ts, TIMESTAMP '2024-03-01' + INTERVAL 1 SECOND * (event_id // 3) AS handled FROM e)
SELECT 'event' AS domain, time_bucket(INTERVAL '1 day', ts) AS window_start, behavior, count(*) AS cnt FROM a GROUP BY 2, 3
UNION ALL SELECT 'processing', time_bucket(INTERVAL '1 minute', handled), behavior, count(*) FROM a GROUP BY 2, 3
""")
def q62_both_time_domains(spark, d):
    """One source in windows of event time and, replayed at three rows a second, of processing time."""
    start = F.lit("2024-03-01").cast("timestamp")
    rows = log(spark, d).withColumn("handled", F.timestamp_seconds(F.unix_seconds(start) + F.floor(F.col("event_id") / 3)))
    counts = lambda ts, size, name: windows.tumbling(rows, size, ts=ts).groupBy(F.lit(name).alias("domain"), naive("window_start"), "behavior").agg(F.count("*").alias("cnt"))
    return counts("ts", "1 day", "event").unionByName(counts("handled", "1 minute", "processing"))


def _recursive(rows: str, state: str, step: str, out: str) -> str:
    """A fold over each key's rows in order, in SQL: ``rows`` numbers them as x(key, k, us, id); ``state`` is the
    state after the first and ``step`` after each further row, as columns of s, with the list ``fired`` of what it emits."""
    return f"""
, x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, id) AS k, count(*) OVER (PARTITION BY key) AS last FROM ({rows})),
s AS (SELECT * FROM (WITH RECURSIVE t AS ({state} UNION ALL {step}) SELECT * FROM t))
{out}
"""


_WINDOW, _TEN = 3_600_000_000, 600_000_000
_FIRED = "STRUCT(window_end BIGINT, fired_at BIGINT, n BIGINT, n_new BIGINT, cause VARCHAR)"


@query(
    _recursive(
        "SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, event_id AS id FROM e",
        f"SELECT key, k, last, us - us % {_WINDOW} + {_WINDOW} AS until, CAST(1 AS BIGINT) AS total, CAST(1 AS BIGINT) AS new, us + {_TEN} AS due, CAST([] AS {_FIRED}[]) AS fired FROM x WHERE k = 1",
        f"""SELECT key, k, last, u3, t3, CASE WHEN n3 >= 3 THEN 0 ELSE n3 END, CASE WHEN n3 >= 3 THEN NULL ELSE coalesce(d3, us + {_TEN}) END,
                   CAST(list_concat(list_concat(e1, e2), CASE WHEN n3 >= 3 THEN [{{'window_end': u3, 'fired_at': us, 'n': t3, 'n_new': n3, 'cause': 'count'}}] ELSE [] END) AS {_FIRED}[])
            FROM (SELECT *, CASE WHEN ended THEN us - us % {_WINDOW} + {_WINDOW} ELSE until END AS u3, CASE WHEN ended THEN 0 ELSE total END + 1 AS t3, CASE WHEN ended THEN 0 ELSE n1 END + 1 AS n3, CASE WHEN ended THEN NULL ELSE d1 END AS d3,
                         CASE WHEN ended THEN [{{'window_end': until, 'fired_at': until, 'n': total, 'n_new': n1, 'cause': 'end'}}] ELSE [] END AS e2
                  FROM (SELECT *, CASE WHEN early THEN 0 ELSE new END AS n1, CASE WHEN early THEN NULL ELSE due END AS d1,
                               CASE WHEN early THEN [{{'window_end': until, 'fired_at': due, 'n': total, 'n_new': new, 'cause': 'time'}}] ELSE [] END AS e1
                        FROM (SELECT x.key, x.k, x.last, x.us, t.until, t.total, t.new, t.due, t.until <= x.us AS ended, coalesce(t.due <= x.us AND t.due < t.until, false) AS early FROM t JOIN x ON x.key = t.key AND x.k = t.k + 1)))""",
        """, f AS (SELECT key, unnest(fired) AS f FROM s UNION ALL
      SELECT key, unnest(list_concat(CASE WHEN due < until THEN [{'window_end': until, 'fired_at': due, 'n': total, 'n_new': new, 'cause': 'time'}] ELSE [] END,
                                     [{'window_end': until, 'fired_at': until, 'n': total, 'n_new': CASE WHEN due < until THEN 0 ELSE new END, 'cause': 'end'}])) FROM s WHERE k = last)
SELECT key, f.window_end AS window_end, f.fired_at AS fired_at, f.n AS n, f.n_new AS n_new, f.cause AS cause FROM f""",
    )
)
def q63_count_and_time_firings(spark, d):
    """Hour windows of each user: at every 3 rows, 10 minutes after the first since, and at the end."""
    return triggers.count_and_time_windows(log(spark, d), "user_id", F.unix_micros("ts"), "event_id", 3, 600_000_000, 3_600_000_000)


_BATCH = "STRUCT(first_id BIGINT, last_id BIGINT, n BIGINT, cause VARCHAR)"


@query(
    _recursive(
        "SELECT 't' || category_id AS key, epoch_us(ts) AS us, event_id AS id FROM e",
        f"SELECT key, k, last, id AS first_id, id AS last_id, CAST(1 AS BIGINT) AS n, us + 43200000000 AS due, CAST([] AS {_BATCH}[]) AS fired FROM x WHERE k = 1",
        f"""SELECT key, k, last, f1, id, CASE WHEN n1 >= 100 THEN 0 ELSE n1 END, d1,
                   CAST(CASE WHEN flush THEN [{{'first_id': first_id, 'last_id': last_id, 'n': n, 'cause': 'time'}}] WHEN n1 >= 100 THEN [{{'first_id': f1, 'last_id': id, 'n': n1, 'cause': 'count'}}] ELSE [] END AS {_BATCH}[])
            FROM (SELECT *, CASE WHEN fresh THEN id ELSE first_id END AS f1, CASE WHEN fresh THEN us + 43200000000 ELSE due END AS d1, CASE WHEN fresh THEN 0 ELSE n END + 1 AS n1
                  FROM (SELECT x.key, x.k, x.last, x.us, x.id, t.first_id, t.last_id, t.n, t.due, t.n > 0 AND x.us >= t.due AS flush, t.n = 0 OR x.us >= t.due AS fresh FROM t JOIN x ON x.key = t.key AND x.k = t.k + 1))""",
        """, f AS (SELECT key, unnest(fired) AS f FROM s UNION ALL SELECT key, {'first_id': first_id, 'last_id': last_id, 'n': n, 'cause': 'time'} FROM s WHERE k = last AND n > 0)
SELECT key, f.first_id AS first_id, f.last_id AS last_id, f.n AS n, f.cause AS cause FROM f""",
    )
)
def q64_table_batches_by_count_or_time(spark, d):
    """Records of each table in batches of 100, or of what came in 12 hours after the first."""
    rows = log(spark, d).withColumn("tbl", F.concat(F.lit("t"), F.col("category_id").cast("string")))
    return triggers.count_or_time(rows, "tbl", F.unix_micros("ts"), "event_id", 100, 43_200_000_000)


@query("""
, t AS (SELECT date_trunc('day', ts) AS window_start, category_id, time_bucket(INTERVAL '10 seconds', ts) + INTERVAL 10 SECOND AS tick, user_id FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY window_start, category_id, user_id ORDER BY tick) AS k FROM (SELECT window_start, category_id, user_id, tick, count(*) AS n FROM t GROUP BY ALL)),
g AS (SELECT window_start, category_id, tick, sum(n) AS n, count(*) FILTER (WHERE k = 1) AS u FROM f GROUP BY 1, 2, 3)
SELECT window_start, category_id, tick, CAST(sum(n) OVER w AS BIGINT) AS pv, CAST(sum(u) OVER w AS BIGINT) AS uv FROM g WINDOW w AS (PARTITION BY window_start, category_id ORDER BY tick)
""")
def q65_day_pv_uv_refreshed(spark, d):
    """Views and users of each category and day so far, every ten seconds that have rows."""
    tick = F.window("ts", "10 seconds")["end"]
    out = windows.early_firings(log(spark, d), F.date_trunc("DAY", "ts"), tick, "user_id", ("category_id",))
    return out.select(naive("window_start"), "category_id", naive("tick"), "pv", "uv")


# ---- patterns


@query(_skip_sql("true"))
def q66_cep_skip_to_next(spark, d):
    return patterns.repeated_then(log(spark, d), "user_id", "event_id", "behavior", "view", "click", "SKIP_TO_NEXT")


@query(_skip_sql("true"))
def q67_cep_skip_to_first(spark, d):
    return patterns.repeated_then(log(spark, d), "user_id", "event_id", "behavior", "view", "click", "SKIP_TO_FIRST")


@query("""
, p AS (SELECT event_id AS id1, behavior AS b1, lead(event_id) OVER w AS id2, lead(behavior) OVER w AS b2 FROM e WINDOW w AS (ORDER BY event_id))
SELECT id1, id2 FROM p WHERE b1 = 'signup' AND b2 = 'error'
""")
def q68_cep_not_keyed(spark, d):
    """A pattern over the whole stream: the next row of all rows, found slot by slot instead of in one task."""
    rows = log(spark, d).select("event_id", "behavior").withColumn("slot", F.floor(F.col("event_id") / 1000))
    heads = rows.groupBy("slot").agg(F.min_by(F.struct("event_id", "behavior"), "event_id").alias("h"))
    following = heads.select(F.lit(0).alias("one"), "slot", "h")
    following = following.withColumn("next_head", F.lead("h").over(Window.partitionBy("one").orderBy("slot"))).select("slot", "next_head")
    rows = rows.join(following, "slot")
    w = Window.partitionBy("slot").orderBy("event_id")
    later = F.coalesce(F.lead(F.struct("event_id", "behavior")).over(w), F.col("next_head"))
    rows = rows.withColumn("n_", later).where("behavior = 'signup' and n_.behavior = 'error'")
    return rows.select(F.col("event_id").alias("id1"), F.col("n_.event_id").alias("id2"))


# ---- change logs

_HISTORY = "CASE WHEN event_id % 40 = 7 THEN 'ALTER TABLE t' || category_id || ' ADD c' || item_id || ' INT' END"


def _with_history(spark, d):
    rows = log(spark, d)
    ddl = F.when(F.col("event_id") % 40 == 7, F.concat(F.lit("ALTER TABLE t"), F.col("category_id").cast("string"), F.lit(" ADD c"), F.col("item_id").cast("string"), F.lit(" INT")))
    op = F.when(F.col("event_id") % 3 == 0, "r").when(F.col("event_id") % 3 == 1, "c").otherwise("u")
    dml = F.to_json(F.struct(F.lit("shop").alias("db"), F.lit("t").alias("table"), op.alias("operator_type"), F.col("event_id").alias("pos"), F.create_map(F.lit("id"), F.col("item_id").cast("string")).alias("after")))
    return rows.select(F.when(ddl.isNotNull(), F.to_json(F.struct(ddl.alias("historyRecord")))).otherwise(dml).alias("raw"))


@query(f"""
SELECT 'history' AS kind, {_HISTORY} AS statement, CAST(NULL AS BIGINT) AS pos FROM e WHERE event_id % 40 = 7
UNION ALL SELECT 'change', NULL, event_id FROM e WHERE event_id % 40 <> 7
""")
def q69_cdc_schema_history(spark, d):
    """Schema changes and row changes of one log, as two outputs."""
    changes, history = changelog.route(_with_history(spark, d), "raw")
    none = F.lit(None)
    left = history.select(F.lit("history").alias("kind"), F.col("history").alias("statement"), none.cast("long").alias("pos"))
    return left.unionByName(changes.select(F.lit("change").alias("kind"), none.cast("string").alias("statement"), "pos"))


@query("""
, c AS (SELECT event_id AS pos, event_id % 3 = 0 AS snapshot FROM e WHERE event_id % 40 <> 7), n AS (SELECT max(event_id) // 2 AS half FROM e)
SELECT 'initial' AS mode, count(*) AS cnt, min(pos) AS first_pos FROM c UNION ALL SELECT 'earliest', count(*), min(pos) FROM c WHERE NOT snapshot
UNION ALL SELECT 'latest', count(*), min(pos) FROM c, n WHERE NOT snapshot AND pos >= half UNION ALL SELECT 'timestamp', count(*), min(pos) FROM c WHERE NOT snapshot AND pos * 1000 >= 500000
UNION ALL SELECT 'specific-offset', count(*), min(pos) FROM c WHERE NOT snapshot AND pos >= 123
""")
def q70_cdc_startup_modes(spark, d):
    """What a reader of the log gets under each startup mode."""
    changes, _ = changelog.route(_with_history(spark, d), "raw")
    half = log(spark, d).agg(F.floor(F.max("event_id") / 2)).first()[0]
    at, out = F.col("pos") * 1000, None
    for mode, start in (("initial", None), ("earliest", None), ("latest", None), ("timestamp", 500_000), ("specific-offset", 123)):
        got = changelog.started(changes, mode, F.col("pos"), F.col("operator_type"), at, start, half)
        got = got.agg(F.lit(mode).alias("mode"), F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))
        out = got if out is None else out.unionByName(got)
    return out


@query("""
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS date_text, strftime(ts, '%H:%M:%S') AS time_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime_text,
       strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS timestamp_text, strftime(CAST(ts AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before, CAST(value > 50 AS INTEGER) AS big FROM e
""")
def q71_cdc_time_texts(spark, d):
    """Database times as text; nulls stay, instants move to the target's zone."""
    rows = log(spark, d)
    days = F.when(F.col("event_id") % 9 != 0, F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")))
    of_day = F.pmod(F.unix_micros("ts"), F.lit(86_400_000_000))
    return rows.select(
        "event_id",
        changelog.time_text("DATE", days).alias("date_text"),
        changelog.time_text("TIME", of_day).alias("time_text"),
        changelog.time_text("DATETIME", F.col("ts")).alias("datetime_text"),
        changelog.time_text("TIMESTAMP", F.col("ts")).alias("timestamp_text"),
        scalar.day_before(F.col("ts")).alias("day_before"),
        F.expr("if(value > 50, 1, 0)").alias("big"),
    )


@query("""
SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN CAST(item_id AS VARCHAR) END, '1') AS id, coalesce(CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END, '0.0') AS qty FROM e
""")
def q72_cdc_fields_with_defaults(spark, d):
    image = F.struct(F.when(F.col("event_id") % 4 != 0, F.col("item_id").cast("string")).alias("id"), F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")).alias("qty"))
    rows = log(spark, d).select("event_id", F.to_json(F.struct(image.alias("after"))).alias("raw"))
    return rows.select("event_id", *changelog.with_defaults("raw", {"id": ("$.after.id", "1"), "qty": ("$.after.qty", "0.0")}))


@query("""
SELECT table_name AS tbl, 'CREATE TABLE IF NOT EXISTS `' || table_name || '` (' || chr(10) || string_agg('  `' || c || '` ' || t || CASE WHEN note <> '' THEN ' COMMENT ' || chr(39) || replace(note, chr(39), chr(39) || chr(39)) || chr(39) ELSE '' END, ',' || chr(10) ORDER BY k) || chr(10) || ') PRIMARY KEY (`id`)' || chr(10) || 'COMMENT ' || chr(39) || chr(39) || chr(10) || 'DISTRIBUTED BY HASH (`id`) BUCKETS 4' || chr(10) || 'PROPERTIES (' || chr(39) || 'replication_num' || chr(39) || ' = ' || chr(39) || '1' || chr(39) || ')' AS ddl
FROM (SELECT lower(r_name) AS table_name, 0 AS k, 'id' AS c, 'bigint' AS t, '' AS note FROM region UNION ALL
      SELECT lower(r_name), n_nationkey + 1, 'c' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'string' ELSE 'int' END, 'the ' || n_name || chr(39) || 's' FROM region JOIN nation ON n_regionkey = r_regionkey) GROUP BY table_name
""")
def q73_target_ddl(spark, d):
    """Statements that make target tables, from a catalogue of columns."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "text").otherwise("int")
    columns = r.join(n, n.n_regionkey == r.r_regionkey).select(F.lower("r_name").alias("tbl"), (F.col("n_nationkey") + 1).cast("int").alias("k"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("c"), kind.alias("t"), F.concat(F.lit("the "), F.col("n_name"), F.lit("'s")).alias("note"))
    columns = columns.unionByName(r.select(F.lower("r_name").alias("tbl"), F.lit(0).alias("k"), F.lit("id").alias("c"), F.lit("bigint").alias("t"), F.lit("").alias("note")))
    return changelog.create_tables(columns, "tbl", "k", "c", "t", "note", "id", 4, 1)


# ---- sinks, functions, lookups


@query("""
SELECT 'shop_t' || category_id AS topic, CAST(user_id AS VARCHAR) AS key, '{"event_id":' || event_id || ',"behavior":"' || behavior || '"}' AS value, ts AS timestamp, CAST(event_id % 4 AS INTEGER) AS partition FROM e
""")
def q74_broker_records(spark, d):
    """Rows as records: the topic that each names, key, JSON value, the row's own time, the partition chosen for it."""
    rows = log(spark, d)
    value = F.to_json(F.struct("event_id", "behavior"))
    topic = F.concat(F.lit("shop_t"), F.col("category_id").cast("string"))
    out = sinks.broker_rows(rows, topic, F.col("user_id"), value, F.col("ts"), F.pmod("event_id", F.lit(4)))
    return out.select("topic", "key", "value", naive("timestamp"), "partition")


@query("""
SELECT event_id, true AS digits_ok, true AS letters_ok, CAST(user_id AS VARCHAR) AS behind, 'Basic ' || to_base64(CAST(user_id || ':' || behavior AS BLOB)) AS auth FROM e
""")
def q75_random_text_and_prefix(spark, d):
    """Random digits and letters by their form; a row behind the number of its task and the time, read back; basic authorisation."""
    rows = log(spark, d).repartition(4)  # dealt round robin
    rows = rows.withColumn("line", scalar.prefixed(F.col("user_id")))
    return rows.select(
        "event_id",
        scalar.random_digits(6, F.col("event_id")).rlike("^[0-9]{6}$").alias("digits_ok"),
        scalar.random_letters(F.col("event_id")).rlike("^[A-Za-z]{11}$").alias("letters_ok"),
        F.regexp_extract("line", r"^[0-9]+\|[0-9]+\|(.*)$", 1).alias("behind"),
        scalar.basic_auth(F.col("user_id").cast("string"), F.col("behavior")).alias("auth"),
    )


class Directory(lookups.Lookup):
    """A store whose answers follow from the key: some keys it does not know, some it refuses, some take too long."""

    def get(self, key):
        if key % 13 == 0:
            raise TimeoutError
        if key % 11 == 0:
            raise ConnectionError("refused")
        return None if key % 7 == 0 else f"Customer#{key:09d}"


@query("""
, r AS (SELECT event_id, user_id, CASE WHEN user_id % 13 = 0 THEN 'timeout' WHEN user_id % 11 = 0 THEN 'exception' WHEN user_id % 7 = 0 THEN 'nothing' ELSE 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS found FROM e)
SELECT event_id, user_id, found, user_id || ' - ' || found AS line FROM r
""")
def q76_async_lookup(spark, d):
    """Lookups at a live store with labels for misses, timeouts and errors."""
    rows = lookups.looked_up(log(spark, d).select("event_id", "user_id"), "user_id", Directory, "found", seconds=1, capacity=100)
    return lookups.with_label(rows, "user_id", "found")


@query("""
SELECT 'pairs' AS shape, count(*) AS cnt, CAST(sum(a) AS BIGINT) AS x, CAST(sum(2 * a + 1) AS BIGINT) AS y FROM (SELECT unnest(generate_series(0, 999)) AS a)
UNION ALL SELECT 'attributes', 1000, 4, 250 UNION ALL SELECT 'coded', 1000, 3, 11 UNION ALL SELECT 'word', 1000, 1, 1 UNION ALL SELECT 'payments', 1000, 1, 1 UNION ALL SELECT 'patterns', 1000, 4, 3
""")
def q77_generators(spark, d):
    """The producers' shapes by what is certain of them."""
    g = lambda shape: connectors.generate(spark.range(1000), shape)
    total = lambda shape, df, x, y: df.agg(F.lit(shape).alias("shape"), F.count("*").alias("cnt"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    parsed = g("attributes").select(F.from_json("value", "attr string, value string, time string").alias("v")).select("v.*")
    out = total("pairs", g("pairs"), F.sum("first"), F.sum("second"))
    out = out.unionByName(total("attributes", parsed, F.countDistinct("attr"), F.countDistinct("time")))
    out = out.unionByName(total("coded", g("coded"), F.max(F.length("code")), F.min(F.length("text"))))
    out = out.unionByName(total("word", g("word"), F.min(F.col("word").rlike("^[A-Z]$").cast("int")), F.max(F.length("word"))))
    out = out.unionByName(total("payments", g("payments"), F.min((F.col("amount") < 100).cast("int")), F.min((F.col("amount") >= 0).cast("int"))))
    return out.unionByName(total("patterns", g("patterns"), F.countDistinct("key"), F.countDistinct("kind")))


@query("""
, g AS (SELECT event_id, item_id, ts, lag(ts) OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) AS before FROM e)
SELECT event_id, item_id FROM g WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 43200000000
""")
def q78_state_with_expiry(spark, d):
    """Rows whose value the key's state does not hold: unseen, or not written for twelve hours."""
    before = F.lag("ts").over(Window.partitionBy("user_id", "item_id").orderBy("ts", "event_id"))
    rows = log(spark, d).withColumn("before", before)
    return rows.where(F.col("before").isNull() | (F.unix_micros("ts") - F.unix_micros("before") > 43_200_000_000)).select("event_id", "item_id")


@query("""
SELECT 'main' AS output, behavior, CAST(NULL AS BIGINT) AS event_id, count(*) AS cnt FROM e GROUP BY 2 UNION ALL SELECT 'big', behavior, event_id, NULL FROM e WHERE value > 99
UNION ALL SELECT 'seen', NULL, 1000 * k, NULL FROM (SELECT unnest(generate_series(1, (SELECT count(*) // 1000 FROM e))) AS k)
""")
def q79_side_outputs(spark, d):
    """One pass that counts, sends large rows to a side output, and reports every thousandth row."""
    rows = log(spark, d)
    main = rows.groupBy(F.lit("main").alias("output"), "behavior").agg(F.count("*").alias("cnt")).withColumn("event_id", F.lit(None).cast("long"))
    big = rows.where("value > 99").select(F.lit("big").alias("output"), "behavior", F.lit(None).cast("long").alias("cnt"), "event_id")
    steps = rows.agg(F.floor(F.count("*") / 1000).alias("n")).where("n > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    seen = steps.select(F.lit("seen").alias("output"), F.lit(None).cast("string").alias("behavior"), F.lit(None).cast("long").alias("cnt"), (F.col("k") * 1000).alias("event_id"))
    return main.unionByName(big).unionByName(seen).select("output", "behavior", "event_id", "cnt")
