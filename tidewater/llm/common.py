"""Shared folder, written tables and connected components for the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Words as the deduplication and mixing operators count them.
WORD = r"[^\x20\x09-\x0D]+"


_made: list[str] = []
_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting (tests, notebooks); it then
    gets a temporary folder once. A cluster without it is an error, because its
    executors could not see a machine-local folder. A path without a scheme is on the
    default file system, as it is everywhere else in Spark; ``file:`` paths on a cluster
    must be a mount that all machines share. ``cleanup`` removes what is left there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:  # the setting can't be changed in a running session
            _local.append("file://" + tempfile.mkdtemp(prefix="tidewater-"))
        base = _local[0]
    if "://" not in base and base.startswith("/"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = ("file://" if default.startswith("file:") else default.rstrip("/")) + base
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def cleanup(spark: SparkSession) -> int:
    """Removes the scratch paths that this driver has made so far; results that still read them are void.

    Returns how many there were."""
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list:
    """The columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def with_text(df: DataFrame) -> tuple[DataFrame, StructType, int]:
    """(the columns of ``df`` as c0, c1, ...; their schema; the place of the text), for Arrow functions that
    pass rows on: they look columns up by name, so clashing or dotted names can't go in. The text goes to the
    workers once; only if it is no string by itself does it follow the others as one more column."""
    named = [c.alias(f"c{k}") for k, c in enumerate(columns_of(df))]
    schema = StructType([StructField(f"c{k}", f.dataType, True) for k, f in enumerate(df.schema.fields)])
    found = [k for k, c in enumerate(df.columns) if c.lower() == "text"]
    if len(found) == 1 and df.columns[found[0]] == "text" and df.schema.fields[found[0]].dataType == StringType():
        return df.select(*named), schema, found[0]
    return df.select(*named, F.col("text").cast("string").alias("t")), schema, len(named)


#: Rows of a batch that a worker handles, and hands back, at a time.
SLICE = 512


@contextmanager
def few_rows(spark: SparkSession, rows: int = 64):
    """Plans made and run inside hand at most ``rows`` rows at a time to a worker, for rows that are large."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(rows))
    try:
        yield
    finally:
        spark.conf.set(limit, before)


#: Edges that one task may finish by itself: about 100 MB of arrays.
TASK_EDGES = 1 << 19


def _forest(batches):
    """Components of all edges of a task, by hooking and pointer jumping: (id, smallest id)."""
    schema = pa.schema([("id", pa.int64()), ("comp", pa.int64())])
    u, v = [], []
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
    if not u:
        return
    nodes, at = np.unique(np.concatenate(u + v), return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], schema=schema)


def components(edges: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of longs: ``(id, comp)``.

    ``comp`` is the smallest id of the component. Nodes without an edge to another
    node are not returned; nulls and self-loops are ignored; no edges give no rows.
    Alternates large-star and small-star steps (each a partial minimum by node and
    an equi-join, which adaptive execution splits at hub nodes) until all edges are
    stars; edges are written to the shared folder after each round. As soon as no more than
    ``task_edges`` are left, one task finishes them, which gives the same result without the shuffles.
    """
    cur = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    cur = written(cur.where("u is not null and v is not null and u <> v").distinct(), "edges")
    for _ in range(rounds):
        if cur.count() <= task_edges:
            return cur.coalesce(1).mapInArrow(_forest, "id long, comp long")
        # stars: no node has two centres, and no centre has one
        ends = cur.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(cur.select(F.col("v").alias("x"), F.lit(-1).alias("n")))
        ends = ends.groupBy("x").agg(F.sum(F.greatest("n", F.lit(0))).alias("n"), F.min("n").alias("centre"))
        if ends.agg(F.count(F.when((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("centre") < 0)), 1))).first()[0] == 0:
            break
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        cur = written(small.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("id")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots.select("id", F.col("id").alias("comp")))


def union_find(n: int, pairs) -> list[tuple[int, int]]:
    """The pairs that join something not joined yet: a spanning forest of ``pairs`` over 0..n-1."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


_held: dict = {}


def held(key: tuple, make):
    """What a worker process keeps between tasks: one object; asking for another drops it.

    Workers are reused by all operators, so caches of several would add up."""
    if _held.get("key") != key:
        _held.clear()
        _held.update(key=key, it=make())
    return _held["it"]


def release() -> None:
    """Drops what the worker process keeps, for an operator that keeps nothing and needs the memory."""
    _held.clear()
