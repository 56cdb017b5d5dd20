"""Joins of event streams and tables; equi-keys first, so nothing becomes a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_UNITS = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000, "WEEK": 604_800_000_000}


def micros(interval: str) -> int:
    """Microseconds of ``-2 DAYS``, ``90 seconds``."""
    n, unit = interval.split()
    return int(n) * _UNITS[unit.upper().rstrip("S")]


def interval_join(left: DataFrame, right: DataFrame, key: str, lower: str, upper: str, open_lower: bool = False) -> DataFrame:
    """Rows of equal ``key`` with left.ts + lower <= right.ts <= left.ts + upper (lower bound open if asked).

    Columns other than the key come from ``left`` with prefix l_, from ``right`` with r_. In batches the
    equi-key also has the slot of time, as wide as the interval: a left row meets the one or two slots
    its interval touches, so a hot key is spread and compared with near rows only. On streams,
    watermarks on both sides bound the state."""
    a = left.select(F.col(key).alias("l_key"), *[F.col(c).alias(f"l_{c}") for c in left.columns if c != key])
    b = right.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    low = F.col("l_ts") + F.expr(f"INTERVAL {lower}")
    after = F.col("r_ts") > low if open_lower else F.col("r_ts") >= low
    on = (F.col("l_key") == F.col("r_key")) & after & (F.col("r_ts") <= F.col("l_ts") + F.expr(f"INTERVAL {upper}"))
    if not (left.isStreaming or right.isStreaming):
        width = F.lit(max(1, micros(upper) - micros(lower)))
        slot = lambda ts, plus: F.floor((F.unix_micros(F.col(ts).cast("timestamp")) + F.lit(plus)) / width)
        a = a.withColumn("l_slot_", F.explode(F.sequence(slot("l_ts", micros(lower)), slot("l_ts", micros(upper)))))
        b = b.withColumn("r_slot_", slot("r_ts", 0))
        on = on & (F.col("l_slot_") == F.col("r_slot_"))
    return a.join(b, on).withColumnRenamed("l_key", key).drop("r_key", "l_slot_", "r_slot_")


def window_join(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join on the key and a common tumbling window; the join is a plain equi-join."""
    a = left.withColumn("w", F.window("ts", size)["start"])
    b = right.withColumn("w", F.window("ts", size)["start"])
    return a.select("w", key, *[F.col(c).alias(f"l_{c}") for c in left.columns if c != key]).join(b.select("w", key, *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key]), ["w", key])


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by a partial maximum of a struct."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r_")).select(key, "r_.*")


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, miss: Column, name: str) -> DataFrame:
    """Left lookup with a default. The optimizer broadcasts ``dim`` if its size is below the threshold."""
    d = dim.select(F.col(dim_key).alias("k_"), F.col(value).alias("v_"))
    return df.join(d, F.col(key) == F.col("k_"), "left").withColumn(name, F.coalesce("v_", miss)).drop("k_", "v_")


def carried(totals: DataFrame, key: str, slot: str, value: Column, name: str) -> DataFrame:
    """Per key and slot, ``value`` over the totals of earlier slots: one short window for each key."""
    before = Window.partitionBy(key).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col(key).alias("ck_"), F.col(slot).alias("cs_"), value.over(before).alias(name))


def as_of(df: DataFrame, history: DataFrame, key: str, ts: str, start: str, slot_s: int = 86_400) -> DataFrame:
    """Each row with the latest history row of its key that had started; rows without one go.

    History and rows are one union, cut into slots of ``slot_s`` seconds and sorted once per key and
    slot; the match is the running last value of the slot or else what earlier slots carry over. The
    cost is linear however long a history is, and a key with a third of all rows is spread by slot."""
    extra = [c for c in history.columns if c not in (key, start)]
    body = F.struct(*[F.col(c) for c in df.columns])
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(slot_s * 1_000_000))
    rows = df.select(F.col(key).alias("k_"), F.col(ts).alias("t_"), slot(ts).alias("s_"), F.lit(1).alias("o_"), body.alias("b_"))
    blank = F.lit(None).cast(rows.schema["b_"].dataType)
    match = F.struct(F.col(start).alias(start), *[F.col(c) for c in extra])
    past = history.select(F.col(key).alias("k_"), F.col(start).alias("t_"), slot(start).alias("s_"), F.lit(0).alias("o_"), blank.alias("b_"), match.alias("m_"))
    rows = rows.withColumn("m_", F.lit(None).cast(past.schema["m_"].dataType))
    ends = past.groupBy("k_", "s_").agg(F.max_by("m_", "t_").alias("m_")).unionByName(rows.select("k_", "s_", "m_").distinct())
    ends = ends.groupBy("k_", "s_").agg(F.first("m_", ignorenulls=True).alias("m_"))
    before = carried(ends, "k_", "s_", F.last("m_", ignorenulls=True), "before_")
    upto = Window.partitionBy("k_", "s_").orderBy("t_", "o_").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(past).withColumn("m_", F.last("m_", ignorenulls=True).over(upto)).where("o_ = 1")
    both = both.join(before, F.col("k_").eqNullSafe(F.col("ck_")) & F.col("s_").eqNullSafe(F.col("cs_")), "left")
    return both.withColumn("m_", F.coalesce("m_", "before_")).where("m_ is not null").select("b_.*", "m_.*")
