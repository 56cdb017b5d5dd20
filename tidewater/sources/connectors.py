"""Sources behind plain options. Endpoints and credentials are always given by the caller."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions import scalar

STARTUP = ("earliest", "latest", "timestamp", "specific-offsets", "group-offsets", "initial")


def parse_offsets(text: str) -> dict[str, int]:
    """``partition:0,offset:42;partition:1,offset:300`` -> {"0": 42, "1": 300}."""
    out: dict[str, int] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        pair = dict(kv.strip().split(":", 1) for kv in part.split(",") if ":" in kv)
        if set(pair) != {"partition", "offset"} or not all(v.lstrip("-").isdigit() for v in pair.values()):
            raise ValueError(f"expected partition:<n>,offset:<n>, found {part!r}")
        out[pair["partition"]] = int(pair["offset"])
    if not out:
        raise ValueError("no offsets given")
    return out


@dataclass
class BrokerOptions:
    """A topic log: servers, topic or pattern, where to start and, for a bounded read, where to end."""

    servers: str
    topic: str | None = None
    pattern: str | None = None
    startup: str | None = None
    offsets: str | None = None
    start_ms: int | None = None
    end_ms: int | None = None
    group: str | None = None
    committed: dict[str, int] | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def options(self, bounded: bool = False) -> dict[str, str]:
        """Options of the reader. Without ``startup`` a stream starts at the latest records, a bounded
        read at the earliest, and ``initial`` is the earliest. A reader can't look up what a group has
        committed, so ``group-offsets`` takes ``committed`` (partition -> next offset)."""
        if (self.topic is None) == (self.pattern is None):
            raise ValueError("give a topic or a pattern")
        mode = (self.startup or ("earliest" if bounded else "latest")).lower()
        if mode not in STARTUP:
            raise ValueError(f"startup must be one of {', '.join(STARTUP)}")
        out = {"kafka.bootstrap.servers": self.servers, **({"subscribe": self.topic} if self.topic else {"subscribePattern": self.pattern})}
        if mode == "timestamp":
            if self.start_ms is None:
                raise ValueError("startup timestamp needs start_ms")
            out["startingTimestamp"] = str(self.start_ms)
        elif mode == "specific-offsets":
            if not self.topic or not self.offsets:
                raise ValueError("specific offsets need a topic and offsets")
            out["startingOffsets"] = json.dumps({self.topic: parse_offsets(self.offsets)})
        elif mode == "group-offsets":
            if not self.topic or not self.committed:
                raise ValueError("group offsets need a topic and the committed offsets")
            out["startingOffsets"] = json.dumps({self.topic: self.committed})
        elif bounded and mode == "latest":
            raise ValueError("a bounded read can't start at the latest records")
        else:
            out["startingOffsets"] = "latest" if mode == "latest" else "earliest"
        if self.group:
            out["kafka.group.id"] = self.group
        if self.end_ms is not None:
            out["endingTimestamp"] = str(self.end_ms)
        return out | self.extra


def read_broker(spark: SparkSession, options: BrokerOptions, bounded: bool = False) -> DataFrame:
    """Records as topic, partition, offset, timestamp, key and value text; needs the broker package."""
    reader = spark.read if bounded else spark.readStream
    df = reader.format("kafka").options(**options.options(bounded)).load()
    return records(df)


def records(df: DataFrame) -> DataFrame:
    """Broker rows with key and value as text; a null key stays null."""
    return df.select("topic", "partition", "offset", "timestamp", F.col("key").cast("string"), F.col("value").cast("string"))


def pulsar_options(service_url: str, admin_url: str, topic: str, start: str = "earliest", subscription: str | None = None) -> dict[str, str]:
    """Options of the external ``pulsar`` reader; the subscription is exclusive, as that reader's always are."""
    if start not in ("earliest", "latest"):
        raise ValueError("start must be earliest or latest")
    out = {"service.url": service_url, "admin.url": admin_url, "topic": topic, "startingOffsets": start}
    return out | ({"predefinedSubscription": subscription} if subscription else {})


def read_pulsar(spark: SparkSession, bounded: bool = False, **options: str) -> DataFrame:
    reader = spark.read if bounded else spark.readStream
    return reader.format("pulsar").options(**pulsar_options(**options)).load()


def read_changes(spark: SparkSession, path: str, stream: bool = True, files_per_batch: int = 1) -> DataFrame:
    """A change log kept as text files of JSON records, as ``raw``; decode with ``changelog.route``.

    Files are read in the order in which they were written, so positions go on from file to file."""
    if not stream:
        return spark.read.text(path).withColumnRenamed("value", "raw")
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "raw")


def replay(spark: SparkSession, path: str, schema, files_per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    """Files as a stream, a few per micro-batch; times without zone become instants, as watermarks need."""
    df = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in df.schema])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def cached_file(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """A small delimited file as a dimension; the optimizer broadcasts it by its size."""
    return spark.read.schema(schema).option("sep", separator).csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """``query`` by JDBC; ``partition`` is (column, lower, upper, parts) for parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, lower, upper, parts = partition
    reader = reader.option("dbtable", f"({query}) t").option("partitionColumn", column)
    return reader.option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts).load()


def sample_rows(spark: SparkSession, cached: DataFrame, per_second: int, path: str, separator: str = ",", seed: int = 7) -> DataFrame:
    """An endless stream of rows drawn from a table, joined to text by ``separator``.

    The table is read once and kept, numbered, in the folder ``path``."""
    parts = {r[0]: r[1] for r in cached.groupBy(F.spark_partition_id()).count().collect()}  # one row for each partition
    n, first = 0, {}
    for p in sorted(parts):
        first[p], n = n, n + parts[p]
    offset = F.create_map(*[F.lit(x) for kv in (first or {0: 0}).items() for x in kv])
    at = F.monotonically_increasing_id()
    text = F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cached.columns])
    numbered = cached.select((offset[F.spark_partition_id()] + at.bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), text.alias("value"))
    numbered.write.mode("overwrite").parquet(path)
    numbered = spark.read.schema("at long, value string").parquet(path)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "value"), F.lit(max(1, n)))).select("at", "timestamp").join(numbered, "at").select("timestamp", "value")


def http_get(url: str, timeout: float = 60, headers: dict[str, str] | None = None) -> str:
    """The body of a GET; lines end as the server ends them."""
    request = urllib.request.Request(url, headers=headers or {"Accept": "text/plain, application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read().decode()


class _Polling(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.url = options["url"]
        self.interval = float(options.get("interval", "1"))
        self.timeout = float(options.get("timeout", "60"))
        self.kept = options.get("keep")

    def initialOffset(self):
        return {"n": 0}

    def _path(self, n: int) -> str:
        return os.path.join(self.kept, f"{n:012d}")

    def read(self, start):
        if start["n"]:
            time.sleep(self.interval)
        body = http_get(self.url, self.timeout)
        if self.kept:  # before the batch is known to the stream
            os.makedirs(self.kept, exist_ok=True)
            with open(self._path(start["n"]) + ".new", "w", newline="") as f:
                f.write(body)
            os.replace(self._path(start["n"]) + ".new", self._path(start["n"]))
        return iter([(start["n"], body)]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start, end):
        """Replies of a batch that runs again: those kept, or none without ``keep`` (at most once)."""
        out = []
        for n in range(start["n"], end["n"]) if self.kept else ():
            with open(self._path(n), newline="") as f:
                out.append((n, f.read()))
        return iter(out)

    def commit(self, end):
        for name in os.listdir(self.kept) if self.kept and os.path.isdir(self.kept) else ():
            if name.isdigit() and int(name) < end["n"]:
                os.remove(os.path.join(self.kept, name))


class HttpPolling(DataSource):
    """``spark.readStream.format("http_polling").option("url", …)``: one row for each reply.

    With option ``keep``, a folder of the driver, replies stay there until their batch is committed,
    so that a restart reads them again; without it they are delivered at most once."""

    @classmethod
    def name(cls):
        return "http_polling"

    def schema(self):
        return "n long, body string"

    def simpleStreamReader(self, schema):
        return _Polling(self.options)


def generated(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """Deterministic rows shaped like the test producers: id, word, code, amount, ts."""
    h = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "id")
    word = F.chr(F.pmod(h(1), F.lit(26)) + 65)
    return spark.range(rows).select("id", word.alias("word"), F.lpad(F.pmod(h(2), F.lit(1000)).cast("string"), 3, "0").alias("code"), (F.pmod(h(3), F.lit(10000)) / 100).alias("amount"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"))


def generate(ids: DataFrame, shape: str, seed: int = 7) -> DataFrame:
    """Rows of one of the producers' shapes for each ``id`` of ``ids``, a batch or a rate stream.

    word: a letter. coded: a code of three digits and a text. attributes: JSON of attr1..attr4 in
    turn, value and time. payments: an account and an amount below 100. pairs: two growing numbers.
    patterns: a key, a kind of a, b, c and a number, as pattern tests want them."""
    rows, h = ids, lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(n))
    if shape == "word":
        return rows.select("id", F.chr(h(1, 26) + 65).alias("word"))
    if shape == "coded":
        return rows.select("id", F.lpad(h(2, 1000).cast("string"), 3, "0").alias("code"), scalar.random_letters(F.col("id"), 11, seed).alias("text"))
    if shape == "attributes":
        body = F.struct(F.concat(F.lit("attr"), (F.pmod("id", F.lit(4)) + 1).cast("string")).alias("attr"), h(3, 1000).cast("string").alias("value"), (F.lit(1704067200000) + F.floor(F.col("id") / 4) * 1000).cast("string").alias("time"))
        return rows.select("id", F.to_json(body).alias("value"))
    if shape == "payments":
        return rows.select("id", h(4, 1000).cast("string").alias("account"), (h(5, 10_000) / 100).alias("amount"))
    if shape == "pairs":
        return rows.select("id", F.col("id").alias("first"), (F.col("id") * 2 + 1).alias("second"))
    if shape == "patterns":
        return rows.select("id", F.concat(F.lit("k"), h(6, 4).cast("string")).alias("key"), F.element_at(F.array(*map(F.lit, "abc")), (h(7, 3) + 1).cast("int")).alias("kind"), h(8, 100).alias("n"))
    raise ValueError("shape must be one of word, coded, attributes, payments, pairs, patterns")


def generated_stream(spark: SparkSession, shape: str, per_second: int = 1000, seed: int = 7) -> DataFrame:
    """The same rows without end, at a rate."""
    ids = spark.readStream.format("rate").option("rowsPerSecond", per_second).load().withColumnRenamed("value", "id")
    return generate(ids, shape, seed)
