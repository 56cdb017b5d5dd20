"""Batches by count or time and windows with early firings, in the order of a key's rows.

What fires next depends on what fired before, so rows of a key are read in order; partitions are
sorted on disk and streamed, and only the counters of the current key are held."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CountOrTimeBatches:
    """Batches of a key: out with ``size`` rows, or ``wait`` after the first of them; the rest at the end."""

    def __init__(self, size: int, wait: int):
        self.size, self.wait, self.held, self.due = size, wait, [], None

    def row(self, at: int, ident: int) -> list[tuple]:
        out = []
        if self.held and at >= self.due:
            out.append((self.held[0], self.held[-1], len(self.held), "time"))
            self.held = []
        if not self.held:
            self.due = at + self.wait
        self.held.append(ident)
        if len(self.held) >= self.size:
            out.append((self.held[0], self.held[-1], len(self.held), "count"))
            self.held = []
        return out

    def end(self) -> list[tuple]:
        out = [(self.held[0], self.held[-1], len(self.held), "time")] if self.held else []
        self.held = []
        return out


class CountAndTimeWindow:
    """Tumbling windows that fire at every ``size`` rows, or ``interval`` after the first row since the
    last firing, and once more at their end, where they are purged.

    A firing is (window end, time, rows of the window so far, rows since the last firing, cause); the
    fourth is all that a function sees when an evictor drops the rows it has had."""

    def __init__(self, size: int, interval: int, window: int):
        self.size, self.interval, self.window = size, interval, window
        self.until, self.total, self.new, self.due = None, 0, 0, None

    def _fire(self, at: int, cause: str) -> tuple:
        out = (self.until, at, self.total, self.new, cause)
        self.new, self.due = 0, None
        return out

    def advance(self, at: int) -> list[tuple]:
        """What timers up to ``at`` fire."""
        out = []
        if self.due is not None and self.due <= at and self.due < self.until:
            out.append(self._fire(self.due, "time"))
        if self.until is not None and self.until <= at:
            out.append(self._fire(self.until, "end"))
            self.until, self.total = None, 0
        return out

    def row(self, at: int, ident: int) -> list[tuple]:
        out = self.advance(at)
        if self.until is None:
            self.until = at - at % self.window + self.window
        self.total, self.new = self.total + 1, self.new + 1
        if self.new >= self.size:
            out.append(self._fire(at, "count"))
        elif self.due is None:
            self.due = at + self.interval
        return out

    def end(self) -> list[tuple]:
        return self.advance(self.until) if self.until is not None else []


def _streamed(make, schema: pa.Schema):
    def run(batches):
        key, core, started, out = None, None, False, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for rows in batches:
            for k, at, ident in zip(*(c.to_pylist() for c in rows.columns)):
                if not started or k != key:
                    if started:
                        out += [(key, *x) for x in core.end()]
                    key, core, started = k, make(), True
                out += [(k, *x) for x in core.row(at, ident)]
            if len(out) >= 4096:
                yield batch()
                out = []
        if started:
            out += [(key, *x) for x in core.end()]
        if out:
            yield batch()

    return run


def _sorted(df: DataFrame, key: str, at: Column, ident: str) -> DataFrame:
    rows = df.select(F.col(key).cast("string").alias("key"), at.cast("long").alias("at"), F.col(ident).cast("long").alias("id"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "id")


def count_or_time(df: DataFrame, key: str, at: Column, ident: str, size: int, wait: int) -> DataFrame:
    """Per batch: key, first_id, last_id, n, cause. ``at`` and ``wait`` are in one unit."""
    schema = pa.schema([("key", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n", pa.int64()), ("cause", pa.string())])
    return _sorted(df, key, at, ident).mapInArrow(_streamed(lambda: CountOrTimeBatches(size, wait), schema), "key string, first_id long, last_id long, n long, cause string")


def count_and_time_windows(df: DataFrame, key: str, at: Column, ident: str, size: int, interval: int, window: int) -> DataFrame:
    """Per firing: key, window_end, fired_at, n, n_new, cause. All times are in the unit of ``at``."""
    schema = pa.schema([("key", pa.string()), ("window_end", pa.int64()), ("fired_at", pa.int64()), ("n", pa.int64()), ("n_new", pa.int64()), ("cause", pa.string())])
    return _sorted(df, key, at, ident).mapInArrow(_streamed(lambda: CountAndTimeWindow(size, interval, window), schema), "key string, window_end long, fired_at long, n long, n_new long, cause string")
