"""Sessions and tables: UTC, micro-second timestamps, the events table as a behaviour log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on; ``conf`` wins."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def behaviour(events: DataFrame) -> DataFrame:
    """Events as a user log: event_id, ts (with zone), user_id, behavior, value, item_id, category_id."""
    item = F.get_json_object("props", "$.k").cast("long")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("behavior"), "value", item.alias("item_id"), (item % 10).alias("category_id"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour(table(spark, sf_dir, "events"))


def naive(column: str, name: str | None = None):
    """A timestamp without zone, as results carry it."""
    return F.col(column).cast("timestamp_ntz").alias(name or column.split(".")[-1])
