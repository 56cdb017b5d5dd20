"""Sinks for batches and streams. Streams write through ``foreachBatch`` under the batch id, so a
batch that is run again replaces what it wrote before."""

from __future__ import annotations

import base64
import json
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of a bulk load.
LOAD = {"max_bytes": 90 << 20, "max_rows": 500_000, "interval_s": 300, "retries": 3}


def day_bucket(date: Column, default: str = "19790101") -> Column:
    """Bucket id from the first eight characters of a date text."""
    head = F.substring(date, 1, 8)
    return F.when(head.rlike("^[0-9]{8}$"), head).otherwise(F.lit(default))


def write_days(df: DataFrame, date: str, path: str, fmt: str = "json", max_records: int = 0) -> None:
    writer = df.withColumn("day", day_bucket(F.col(date))).write.mode("append").partitionBy("day").option("maxRecordsPerFile", max_records)
    writer.format(fmt).save(path)


def write_rolling(df: DataFrame, path: str, max_bytes: int = 400 << 20, bucket: Column | None = None, fmt: str = "text") -> None:
    """Lines in files of at most ``max_bytes``, by bucket if one is given.

    Files are cut by rows: as many as fit if all were as long as the longest, so no file is larger."""
    longest = df.agg(F.max(F.octet_length("value"))).first()[0] or 0
    writer = df.withColumn("bucket", bucket) if bucket is not None else df
    writer = writer.write.mode("append").option("maxRecordsPerFile", max(1, max_bytes // (longest + 1)))
    (writer.partitionBy("bucket") if bucket is not None else writer).format(fmt).save(path)


def broker_rows(df: DataFrame, topic: Column | str, key: Column | None = None, value: Column | None = None, timestamp: Column | None = None, partition: Column | None = None) -> DataFrame:
    """Rows as a broker writer takes them: topic (fixed, or of each row), key, value, timestamp, partition.

    ``value`` is by default the row as JSON; ``timestamp`` is written with the record."""
    columns = [(F.lit(topic) if isinstance(topic, str) else topic).cast("string").alias("topic")]
    columns.append((F.lit(None) if key is None else key).cast("string").alias("key"))
    columns.append((F.to_json(F.struct(*df.columns)) if value is None else value).cast("string").alias("value"))
    if timestamp is not None:
        columns.append(timestamp.cast("timestamp").alias("timestamp"))
    if partition is not None:
        columns.append(partition.cast("int").alias("partition"))
    return df.select(*columns)


def partitioner(mode: str, n: int, key: Column | None = None) -> Column:
    """Partition of each record: ``fixed`` (one for each writing task), ``round-robin``, or ``custom`` by a key."""
    if mode == "fixed":
        return F.pmod(F.spark_partition_id(), F.lit(n))
    if mode == "round-robin":
        return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    if mode == "custom" and key is not None:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    raise ValueError("partitioner must be fixed, round-robin or custom with a key")


def broker_options(servers: str, exactly_once: bool = False, **extra: str) -> dict[str, str]:
    """Producer options; the writer delivers at least once, so with ``exactly_once`` retries don't reorder
    or repeat records inside a batch, and ``broker_once`` keeps whole batches from being sent again."""
    out = {"kafka.bootstrap.servers": servers}
    if exactly_once:
        out |= {"kafka.enable.idempotence": "true", "kafka.acks": "all"}
    return out | {(k if k.startswith("kafka.") else f"kafka.{k}"): v for k, v in extra.items()}


def broker(servers: str, fmt: str = "kafka", **extra: str):
    """A foreachBatch function for rows of ``broker_rows``, at least once; needs the broker package."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.format(fmt).mode("append").options(**broker_options(servers, **extra)).save()

    return write


def broker_once(ledger: str, send):
    """A foreachBatch function that hands each batch to ``send(batch, batch_id)`` once.

    Batches that were sent are named in the folder ``ledger``; one that runs again after it was named
    is left out. A driver that dies between sending and naming sends once more, under the same batch
    id, by which a reader can tell: rows carry it in the column ``batch``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/sent={batch_id}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return
        send(batch.withColumn("batch", F.lit(batch_id)), batch_id)
        spark.range(1).write.mode("overwrite").parquet(f"{ledger}/sent={batch_id}")

    return write


def console(stream: DataFrame, checkpoint: str, mode: str = "append", rows: int = 20):
    """Prints each micro-batch of a stream as a table."""
    return stream.writeStream.outputMode(mode).format("console").option("numRows", rows).option("truncate", False).option("checkpointLocation", checkpoint)


def printed(prefix: str = "", limit: int = 1000):
    """A foreachBatch function that prints rows behind a prefix; at most ``limit`` of each batch reach the driver."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for row in batch.take(limit):
            print(f"{prefix}{'> ' if prefix else ''}{', '.join(map(str, row))}", flush=True)

    return write


def write_topics(df: DataFrame, topic: str, path: str) -> None:
    """Rows as JSON under the topic that each names."""
    df.select(F.col(topic).alias("topic"), F.to_json(F.struct(*[c for c in df.columns if c != topic])).alias("value")).write.mode("append").partitionBy("topic").text(path)


def once(path: str, fmt: str = "parquet"):
    """A foreachBatch function: each batch has a folder of its own, replaced when it runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")

    return write


def upsert(path: str, keys: list[str], order: str, buckets: int = 64):
    """A foreachBatch function that keeps the latest row of each key in buckets by the hash of the key.

    Batch n writes anew only the buckets that it has rows of, as generation n, from the newest older
    generation of each; so a batch costs in proportion to the buckets it touches, and one that runs
    again finds what it found before. ``compact`` removes generations that no batch needs any more."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
            old = _generations(spark, path, batch_id - 1)
            folders = [f"{path}/generation={old[b]}/bucket={b}" for b in touched if b in old]
            both = rows
            if folders:
                kept = spark.read.schema(batch.schema).parquet(*folders)
                both = rows.unionByName(kept.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
            rest = [c for c in batch.columns if c not in keys]
            last = both.groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r_")).select("bucket", *keys, "r_.*")
            last.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/generation={batch_id}")
        finally:
            rows.unpersist()

    return write


def _listed(spark, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []


def _generations(spark, path: str, upto: int) -> dict[int, int]:
    """Bucket -> newest finished generation of at most ``upto``."""
    found: dict[int, int] = {}
    for name in _listed(spark, path):
        generation = int(name.partition("=")[2]) if name.startswith("generation=") else upto + 1
        inside = _listed(spark, f"{path}/{name}") if generation <= upto else []
        for b in (int(x.partition("=")[2]) for x in inside if x.startswith("bucket=") and "_SUCCESS" in inside):
            found[b] = max(generation, found.get(b, generation))
    return found


def upserted(spark, path: str, batch_id: int, deleted: str | None = None) -> DataFrame:
    """The table after a batch; rows whose ``deleted`` is 1 are left out."""
    newest = _generations(spark, path, batch_id)
    df = spark.read.parquet(*[f"{path}/generation={g}/bucket={b}" for b, g in sorted(newest.items())])
    return df.where(f"coalesce({deleted}, 0) = 0").drop(deleted) if deleted else df


def compact(spark, path: str, batch_id: int) -> int:
    """Removes buckets of generations up to ``batch_id`` that a newer one has replaced; returns how many."""
    newest, gone = _generations(spark, path, batch_id), 0
    for name in _listed(spark, path):
        generation = int(name.partition("=")[2]) if name.startswith("generation=") else batch_id + 1
        for b in (int(x.partition("=")[2]) for x in _listed(spark, f"{path}/{name}") if x.startswith("bucket=") and generation <= batch_id):
            if newest.get(b, generation) != generation:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/bucket={b}")
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
                gone += 1
    return gone


def each_row(connect, statement: str, columns: list[str]):
    """A foreachBatch function that runs ``statement`` for each row and commits it, on a connection per task.

    ``connect()`` gives a DB-API connection without autocommit; one row's failure undoes that row alone and is raised."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def send(rows):
            connection = connect()
            try:
                cursor = connection.cursor()
                for row in rows:
                    try:
                        cursor.execute(statement, tuple(row))
                        connection.commit()
                    except Exception:
                        connection.rollback()
                        raise
            finally:
                connection.close()

        batch.select(*columns).foreachPartition(send)

    return write


def jdbc(url: str, target: str, batch_size: int = 100, **options: str):
    """A foreachBatch function that appends by JDBC in batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.format("jdbc").mode("append").option("url", url).option("dbtable", target).option("batchsize", batch_size).options(**options).save()

    return write


def _put(url: str, label: str, body: bytes, user: str, password: str, headers: dict[str, str], retries: int) -> None:
    token = base64.b64encode(f"{user}:{password}".encode()).decode()
    for attempt in range(retries + 1):
        request = urllib.request.Request(url, data=body, method="PUT", headers={"Authorization": f"Basic {token}", "label": label, **headers})
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                reply = json.loads(r.read() or b"{}")
            if reply.get("Status") in ("Success", "Publish Timeout", "Label Already Exists"):
                return
            problem = RuntimeError(f"load {label} failed: {reply.get('Status')}")
        except OSError as e:
            problem = e
        if attempt == retries:
            raise problem


def bulk_load(url: str, job: str, line: str, user: str, password: str, max_rows: int = LOAD["max_rows"], max_bytes: int = LOAD["max_bytes"], retries: int = LOAD["retries"], **headers: str):
    """A foreachBatch function that puts delimited lines in bounded requests from the executors.

    Labels are made of job, batch, partition and request, so a repeated request is known to the
    target; the reply's status is checked, not the HTTP code alone."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def send(rows):
            from pyspark import TaskContext

            part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

            def flush():
                nonlocal n, held, size
                _put(url, f"{job}-{batch_id}-{part}-{n}", "\x02".join(held).encode(), user, password, headers, retries)
                n, held, size = n + 1, [], 0

            for row in rows:
                held.append(row[0])
                size += len(row[0])
                if len(held) >= max_rows or size >= max_bytes:
                    flush()
            if held:
                flush()

        batch.select(line).foreachPartition(send)

    return write


def bulk_load_tables(url, table: str, columns_of, job: str, user: str, password: str, deleted: str = "deleted", image: str = "image", **options):
    """A foreachBatch function that loads change records into the table that each names.

    ``url(table)`` is the address of a table's loads; ``columns_of(table)`` its columns, asked once for
    each table. Lines hold the columns of the ``image`` map in that order and the operation last."""
    from ..operators.changelog import load_line

    known: dict[str, list[str]] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            for (name,) in sorted(map(tuple, rows.select(table).distinct().collect())):  # one row for each target table
                if name not in known:
                    known[name] = list(columns_of(name))
                cells = [F.try_element_at(F.col(image), F.lit(c)) for c in known[name]]
                lines = rows.where(F.col(table) == name).select(load_line([*cells, F.col(deleted)]).alias("line"))
                bulk_load(url(name), f"{job}-{name}", "line", user, password, **options)(lines, batch_id)
        finally:
            rows.unpersist()

    return write
