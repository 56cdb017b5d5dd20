"""Watermark strategies in batch form: the watermark in force when each row arrives.

Structured Streaming has one strategy, the largest time seen less a delay, moved on between
micro-batches and never back. The others exist here as columns over rows in order of arrival, so
that results which depend on them can be stated and tested; ``streaming.jobs`` says what takes
their place on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import running_max_before

#: ascending: largest time so far less a millisecond. bounded: less the delay too. punctuated: the
#: largest time, moved by every larger row. current: the row's own time less a millisecond, which
#: may go back. periodic: largest time less a lag, kept between ticks of arrival.
STRATEGIES = ("none", "ascending", "bounded", "punctuated", "current", "periodic")


def watermark(df: DataFrame, by: str, arrival: str, strategy: str, name: str, delay_us: int = 0, tick: int = 1, ts: str = "ts") -> DataFrame:
    """``df`` with the watermark in microseconds right after each row of ``by`` has come."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    at = F.unix_micros(ts)
    if strategy == "none":
        return df.withColumn(name, F.lit(None).cast("long"))
    if strategy == "current":
        return df.withColumn(name, at - 1000)
    rows = running_max_before(df, by, arrival, at, "high_")
    high = F.greatest("high_", at)
    if strategy == "periodic":  # the largest time of all rows before the last tick
        whole = F.floor(F.col(arrival) / F.lit(tick))
        per = rows.groupBy(by, whole.alias("tick_")).agg(F.max(high).alias("top_"))
        before = Window.partitionBy(by).orderBy("tick_").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(F.col(by).alias("b_"), F.col("tick_").alias("t_"), F.max("top_").over(before).alias("top_"))
        rows = rows.withColumn("tick_", whole).join(per, F.col(by).eqNullSafe(F.col("b_")) & (F.col("tick_") == F.col("t_")))
        return rows.withColumn(name, F.col("top_") - F.lit(delay_us)).drop("high_", "tick_", "t_", "b_", "top_")
    less = {"ascending": 1000, "bounded": delay_us + 1000, "punctuated": 0}[strategy]
    return rows.withColumn(name, high - F.lit(less)).drop("high_")


def reassigned(df: DataFrame, ts: Column, name: str = "ts") -> DataFrame:
    """A later assignment wins: what follows goes by the new time alone."""
    return df.withColumn(name, ts)


def with_idle(per_source: DataFrame, source: str, step: str, mark: str, idle_steps: int) -> DataFrame:
    """The watermark over all sources at each step: the least of those that are not idle, or null.

    ``per_source`` has a row for each source and step in which the source had rows: its watermark
    then. A source counts from its first row on, and is idle after ``idle_steps`` steps without one."""
    following = F.lead(step).over(Window.partitionBy(source).orderBy(step))
    own = per_source.select(source, F.col(step).alias("from_"), F.col(mark).alias("m_"), following.alias("to_"))
    until = F.least(F.coalesce("to_", F.col("from_") + F.lit(idle_steps)), F.col("from_") + F.lit(idle_steps))
    live = own.select("m_", F.explode(F.sequence(F.col("from_"), until - 1)).alias(step))
    steps = per_source.select(step).distinct()
    return steps.join(live, step, "left").groupBy(step).agg(F.min("m_").alias(mark))
