"""Streaming forms of the batch operators: same columns, watermarks instead of whole tables.

Watermarks: a stream has one strategy, the largest time seen less a delay, which moves on between
micro-batches and never back. So ascending and punctuated strategies are a delay of zero, a lag or
bounded disorder is a delay, and "current" (which may go back) is a delay of zero. The watermark is
over all partitions together and does not wait for one that is silent, so idle sources need no
timeout; several streams take the least (or with ``spark.sql.streaming.multipleWatermarkPolicy``
the largest). Without ``withWatermark`` there is none, and a later call replaces an earlier one on a
column made anew. ``operators.watermarks`` has the strategies row by row, for batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins


def windowed_counts(stream: DataFrame, size: str, delay: str, keys: list[str], slide: str | None = None, offset: str | None = None) -> DataFrame:
    """Counts per window and key; rows later than the watermark allows are dropped."""
    w = F.window("ts", size, slide or size, offset) if offset else F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("cnt"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "cnt")


def distinct_per_window(stream: DataFrame, size: str, delay: str, keys: list[str], user: str) -> DataFrame:
    """uv per window and key: duplicates go first, since streams have no distinct count."""
    rows = stream.withWatermark("ts", delay).withColumn("w", F.window("ts", size)).select("w", F.window_time("w").alias("wt"), *keys, user)
    once = rows.dropDuplicates(["w", *keys, user])
    return once.groupBy("w", *keys).agg(F.count("*").alias("uv")).select(F.col("w.start").alias("window_start"), *keys, "uv")


def interval_join(left: DataFrame, right: DataFrame, key: str, lower: str, upper: str, delay: str) -> DataFrame:
    """Both sides have watermarks, so the range predicate bounds the state."""
    return joins.interval_join(left.withWatermark("ts", delay), right.withWatermark("ts", delay), key, lower, upper)


def top_n_of_batches(path: str, by: str, order: list[str], n: int):
    """A foreachBatch function that ranks the updated aggregates of a batch."""
    from ..operators.windows import top_n

    def write(batch: DataFrame, batch_id: int) -> None:
        top_n(batch, [by], [F.desc(order[0]), *[F.asc(c) for c in order[1:]]], n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(df: DataFrame, checkpoint: str, name: str | None = None, mode: str = "append", foreach=None):
    """Runs a stream over what is there and stops; to memory table ``name`` or a foreachBatch function."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(foreach) if foreach else writer.format("memory").queryName(name)).start()
    query.awaitTermination()
    return query


def refreshed_lookup(load_dim, key: str, dim_key: str, value: str, miss: str, name: str, sink):
    """A foreachBatch function: the dimension is read anew for each batch, then looked up with a default.

    ``load_dim(spark)`` reads the table, ``sink(batch, batch_id)`` takes the result."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(joins.lookup(batch, load_dim(batch.sparkSession), key, dim_key, value, F.lit(miss), name), batch_id)

    return write


def connected(data: DataFrame, config: DataFrame, key: str, value: str) -> DataFrame:
    """Two streams as one, tagged: config rows carry ``value``, data rows the columns of ``data``."""
    rest = [c for c in data.columns if c != key]
    left = data.select(key, F.struct(*rest).alias("data"), F.lit(None).cast("string").alias("config"), "ts")
    right = config.select(key, F.lit(None).cast(left.schema["data"].dataType).alias("data"), F.col(value).cast("string").alias("config"), "ts")
    return left.unionByName(right)


def watermarked(stream: DataFrame, strategy: str = "bounded", delay: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """A stream under one of the strategies of ``operators.watermarks``, or what takes its place."""
    from ..operators.watermarks import STRATEGIES

    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if strategy == "none":
        return stream
    return stream.withWatermark(ts, delay if strategy in ("bounded", "periodic") else "0 seconds")


def processing_time_counts(stream: DataFrame, size: str, keys: list[str], offset: str = "0 seconds") -> DataFrame:
    """Counts per window of the time at which rows are handled; emitted by update at each trigger."""
    w = F.window("handled_", size, size, offset)
    out = stream.withColumn("handled_", F.current_timestamp()).withWatermark("handled_", "0 seconds").groupBy(w.alias("w"), *keys).agg(F.count("*").alias("cnt"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "cnt")


def both_domains(stream: DataFrame, size: str, delay: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One source counted in windows of event time and, as a second query, of processing time."""
    return windowed_counts(stream, size, delay, keys), processing_time_counts(stream, size, keys)


def refreshed(df: DataFrame, checkpoint: str, every: str, sink, mode: str = "update"):
    """Emits what has changed every ``every`` of processing time, to a foreachBatch function."""
    return df.writeStream.outputMode(mode).trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(sink).start()


def late_updates(stream: DataFrame, size: str, delay: str, allowed: str, keys: list[str]) -> DataFrame:
    """Counts of windows that stay open for ``allowed`` after the watermark passed their end.

    In update mode a late row that is still allowed emits its window again, and rows later than that go."""
    from ..operators.joins import micros

    whole = micros(delay) + micros(allowed)
    return windowed_counts(stream, size, f"{whole // 1000} milliseconds", keys)


def counted(df: DataFrame, every: int = 1000, name: str = "seen") -> DataFrame:
    """Metrics of rows and of whole ``every`` of them, in the progress of each batch."""
    return df.observe(name, F.count("*").alias("rows"), F.floor(F.count("*") / every).alias("thousands" if every == 1000 else "steps"))


def replicated_table(changes: DataFrame, json: str, table: str, columns: list[str]) -> DataFrame:
    """Load lines of one table of a change log: its columns in order and the operation last."""
    from ..operators import changelog

    rows = changelog.decode(changes, json).where(F.col("table") == table)
    image, deleted = changelog.payload(F.col("operator_type"), F.col("before"), F.col("after"))
    rows = rows.withColumn("image", image).withColumn("deleted", deleted)
    return rows.select(changelog.load_line([*[F.try_element_at("image", F.lit(c)) for c in columns], F.col("deleted")]).alias("line"))


def replicate_table(changes: DataFrame, json: str, table: str, columns: list[tuple[str, str, str]], key: str, checkpoint: str, execute, load):
    """Replicates a table: ``execute`` gets the statement that makes the target first, then ``load`` each batch of lines."""
    from ..operators.changelog import create_table

    execute(create_table(columns, table, key))
    lines = replicated_table(changes, json, table, [c for c, _, _ in columns])
    return run_available(lines, checkpoint, foreach=load)


def table_batches(changes: DataFrame, json: str, delay: str, size: int = 10_000, wait_ms: int = 10_000, ts: str = "ts") -> DataFrame:
    """Whole databases in batches of each table: ``size`` records, or what has come ``wait_ms`` after the first.

    ``changes`` has the record's time in ``ts``, under a watermark of ``delay``."""
    from ..operators import changelog
    from .processors import CountOrTime

    rows = changelog.decode(changes.withWatermark(ts, delay), json)
    rows = rows.select(F.concat_ws(".", "db", "table").alias("tbl"), F.col("pos").alias("event_id"), F.col(ts).alias("ts"))
    p = CountOrTime(size, wait_ms, key="tbl string")
    return rows.groupBy("tbl").transformWithState(p, p.OUTPUT, "Append", "EventTime")
