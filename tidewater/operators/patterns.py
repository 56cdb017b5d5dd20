"""Event patterns: strict and relaxed contiguity by window functions, ``a+ b`` with skip strategies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("NO_SKIP", "SKIP_TO_NEXT", "SKIP_PAST_LAST_EVENT", "SKIP_TO_FIRST", "SKIP_TO_LAST")


def strict(df: DataFrame, key: str, order: str, conditions: list, carry: list[str]) -> DataFrame:
    """Consecutive rows of a key that meet ``conditions`` in turn: functions of a getter, so a later
    condition may look at earlier rows of the match. Columns ``carry`` come once per position."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df
    for k in range(1, len(conditions)):
        for c in carry:
            rows = rows.withColumn(f"{c}_{k + 1}", F.lead(c, k).over(w))
    for c in carry:
        rows = rows.withColumn(f"{c}_1", F.col(c))

    def at(name: str, position: int) -> Column:
        return F.col(f"{name}_{position}")

    found = rows
    for condition in conditions:
        found = found.where(condition(at))
    return found.select(key, *[f"{c}_{k + 1}" for k in range(len(conditions)) for c in carry])


def followed_by(df: DataFrame, key: str, order: str, after: int, condition: Column, name: str) -> DataFrame:
    """``df`` with the order value of the first row that meets ``condition``, ``after`` or more rows later.

    In descending order the later rows are a growing frame, so the minimum is kept up and the cost is linear."""
    later = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -after)
    return df.withColumn(name, F.min(F.when(condition, F.col(order))).over(later))


def one_or_more_then(kinds: list[str], a: str, b: str, strategy: str) -> list[list[int]]:
    """Matches of ``a+ b`` (strictly consecutive) in a sequence of kinds, as lists of positions."""
    runs, out = [], []
    for i, kind in enumerate(kinds):
        if kind == a:
            runs.append(i)
            continue
        if kind == b and runs:
            matches = [[*runs[k:], i] for k in range(len(runs))]
            if strategy == "SKIP_PAST_LAST_EVENT":
                matches = matches[:1]
            elif strategy == "SKIP_TO_LAST":
                matches = matches[:1] + (matches[-1:] if len(matches) > 1 else [])
            elif strategy not in STRATEGIES:
                raise ValueError(strategy)
            out += matches
        runs = []
    return out


def _runs(a: str, b: str, strategy: str):
    schema = pa.schema([("key", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        key, ids = None, []
        for batch in batches:
            out = []
            for k, i, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    key, ids = k, []
                if kind == a:
                    ids.append(i)
                    continue
                if kind == b and ids:
                    for m in one_or_more_then([a] * len(ids) + [b], a, b, strategy):
                        out.append((k, ids[m[0]], i, len(m)))
                ids = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def repeated_then(df: DataFrame, key: str, order: str, kind: str, a: str, b: str, strategy: str) -> DataFrame:
    """``a+ b`` per key, streamed over sorted partitions: only the current run of ``a`` is held."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("id"), F.col(kind).alias("kind"))
    rows = rows.repartition("key").sortWithinPartitions("key", "id")
    return rows.mapInArrow(_runs(a, b, strategy), "key long, first_id long, last_id long, n long")
