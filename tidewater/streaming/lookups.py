"""Lookups at a live store while rows pass: bounded in number and time, with labels instead of failures."""

from __future__ import annotations

import asyncio
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Lookup:
    """What a lookup does; subclasses connect in ``open`` and answer in ``get`` (or ``ask``, a coroutine).

    ``get`` runs in a thread, so a blocking client is fine; None is a miss."""

    miss, timeout, error = "nothing", "timeout", "exception"

    def open(self) -> None:
        pass

    def get(self, key):
        raise NotImplementedError

    async def ask(self, key):
        return await asyncio.to_thread(self.get, key)

    def close(self) -> None:
        pass


async def _all(lookup: Lookup, keys: list, seconds: float, capacity: int) -> list[str]:
    gate = asyncio.Semaphore(capacity)

    async def one(key):
        async with gate:
            try:
                found = await asyncio.wait_for(lookup.ask(key), seconds)
            except (asyncio.TimeoutError, TimeoutError):
                return lookup.timeout
            except Exception:  # the label stands for whatever the store answered
                return lookup.error
            return lookup.miss if found is None else str(found)

    return await asyncio.gather(*map(one, keys))


def looked_up(df: DataFrame, key: str, make, name: str, seconds: float = 5.0, capacity: int = 100) -> DataFrame:
    """``df`` with ``name``: what ``make()``, a Lookup, says of ``key``, or its label for a miss, a timeout, an error.

    One client for each task; at most ``capacity`` requests are open at a time, each for ``seconds``.
    Equal keys of a batch are asked once. Null keys are a miss. Works on batches and on streams."""
    schema = df.schema

    def run(batches):
        lookup = make()
        lookup.open()
        try:
            for batch in batches:
                keys = batch.column(batch.schema.names.index(key)).to_pylist()
                wanted = sorted({k for k in keys if k is not None}, key=repr)
                answers = dict(zip(wanted, asyncio.run(_all(lookup, wanted, seconds, capacity))))
                found = pa.array([lookup.miss if k is None else answers[k] for k in keys], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])
        finally:
            lookup.close()

    return df.mapInArrow(run, StructType([*schema.fields, StructField(name, StringType())]))


class Pause(Lookup):
    """A store that waits before each answer, for tests and load runs: ``wait`` seconds, then the key."""

    def __init__(self, wait: float):
        self.wait = wait

    def get(self, key):
        time.sleep(self.wait)
        return key


def with_label(df: DataFrame, key: str, value: str, name: str = "line") -> DataFrame:
    """Input and result as one text."""
    return df.withColumn(name, F.concat_ws(" - ", F.col(key).cast("string"), F.col(value)))
