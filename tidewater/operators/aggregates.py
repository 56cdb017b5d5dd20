"""Aggregations: all of them partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(column: str = "value") -> Column:
    """Amounts as whole hundredths, so that sums do not depend on their order."""
    return F.round(F.col(column) * 100).cast("long")


def pv_uv(df: DataFrame, keys: list, user: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("pv"), F.countDistinct(user).alias("uv"))


def conditional_counts(df: DataFrame, keys: list, column: str, values: list[str]) -> DataFrame:
    """One row for each group and value, zero counts included."""
    wide = df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    names = [c for c in wide.columns if c not in values]
    return wide.unpivot(names, values, column, "cnt")


def chosen_statistic(method: Column, value: Column) -> Column:
    """sum, count, min or max of ``value`` by the name in ``method``, in any case; null for another name."""
    m = F.lower(F.max(method))
    return F.when(m == "sum", F.sum(value)).when(m == "count", F.count(value)).when(m == "min", F.min(value)).when(m == "max", F.max(value))


def running(df: DataFrame, key: str, order: str, **columns: Column) -> DataFrame:
    """Aggregates over all rows of the key so far."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[c.over(upto).alias(n) for n, c in columns.items()])


def first_last(df: DataFrame, keys: list, order: str, ident: str, amount: Column) -> DataFrame:
    """First and last id in order and the amounts: their sum, and joined in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), amount.alias("a_")))), lambda r: r["a_"].cast("string"))
    return df.groupBy(*keys).agg(F.min_by(ident, order).alias("first_id"), F.max_by(ident, order).alias("last_id"), F.sum(amount).alias("total"), F.array_join(rows, "|").alias("joined"))


def retention(df: DataFrame, user: str, day: Column) -> DataFrame:
    """Per day: users known before it, users new the day before, new on it, and the share of
    yesterday's new ones that are seen again (0 if there were none).

    Two shuffles: activity per (user, day), then sums per day; no history is collected."""
    active = df.select(F.col(user).alias("user"), day.alias("day")).distinct()
    firsts = active.groupBy("user").agg(F.min("day").alias("first_day"))
    days = active.select("day").distinct()
    new = firsts.groupBy(F.col("first_day").alias("day")).agg(F.count("*").alias("n"))
    again = active.join(firsts, "user").where(F.col("day") == F.date_add("first_day", 1)).groupBy("day").agg(F.count("*").alias("kept"))
    rows = days.join(new, "day", "left").join(new.select(F.date_add("day", 1).alias("day"), F.col("n").alias("last_new")), "day", "left").join(again, "day", "left")
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    rows = rows.select("day", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("known"), F.coalesce("last_new", F.lit(0)).alias("last_new"), F.coalesce("n", F.lit(0)).alias("cur_new"), F.coalesce("kept", F.lit(0)).alias("kept"))
    return rows.withColumn("ratio", F.when(F.col("last_new") > 0, F.col("kept") / F.col("last_new")).otherwise(F.lit(0.0)))
