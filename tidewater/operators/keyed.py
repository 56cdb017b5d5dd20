"""Keyed state in batch form: alerts with timers, count batches, key changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import carried


def small_then_large(df: DataFrame, key: str, small: float, large: float, timeout_us: int) -> DataFrame:
    """Alerts with the exact timer semantics: each small amount registers a timer, the earliest
    pending timer clears the flag. A large amount alerts if the flag is up.

    ``smin`` is the earliest small amount whose timer was pending at a small amount; the flag
    that it raised is up until smin + timeout. Needs a total order of ts within a key."""
    at = F.unix_micros("ts")
    rows = df.withColumn("us", at).withColumn("s_", F.when(F.col("value") < small, at))
    back = Window.partitionBy(key).orderBy("us").rangeBetween(-(timeout_us - 1), 0)
    rows = rows.withColumn("smin", F.when(F.col("s_").isNotNull(), F.min("s_").over(back)))
    past = Window.partitionBy(key).orderBy("us").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("flag", F.last("smin", ignorenulls=True).over(past))
    return rows.where((F.col("value") > large) & (F.col("flag") + timeout_us > F.col("us"))).drop("us", "s_", "smin", "flag")


def count_batches(df: DataFrame, key: str, order: str, size: int, slot: int = 100_000) -> DataFrame:
    """``df`` with batch_no: every ``size`` rows of a key in order are a batch.

    Rows are numbered inside slots of the order, plus the rows of earlier slots, so that few keys
    with many rows are spread over tasks."""
    rows = df.withColumn("s_", F.floor(F.col(order) / F.lit(slot)))
    before = carried(rows.groupBy(key, "s_").agg(F.count("*").alias("n_")), key, "s_", F.sum("n_"), "before_")
    rows = rows.withColumn("at_", F.row_number().over(Window.partitionBy(key, "s_").orderBy(order)))
    rows = rows.join(before, F.col(key).eqNullSafe(F.col("ck_")) & F.col("s_").eqNullSafe(F.col("cs_")))
    number = F.floor((F.col("at_") + F.coalesce("before_", F.lit(0)) - 1) / size).cast("long")
    return rows.withColumn("batch_no", number).drop("s_", "at_", "before_", "ck_", "cs_")


def changes(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Rows whose ``column`` differs from the row before of the same key; the first row is no change."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("previous", F.lag(column).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(column)))
