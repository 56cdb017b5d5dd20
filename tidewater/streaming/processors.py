"""Keyed processors with state and timers, for ``groupBy(key).transformWithState``.

All need the RocksDB state store. Rows of a key are handled in order of their time within a
micro-batch; timers fire when the watermark passes them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _ms(ts) -> int:
    return round(ts.timestamp() * 1000)


class SmallThenLarge(StatefulProcessor):
    """A small amount raises a flag and sets a timer; each timer that is due clears the flag; a
    large amount under the flag is an alert. Pending timers are kept as state and replayed
    against row times, so results do not depend on micro-batches. A key without a pending timer
    holds no state; with ``expire`` (event-time mode) the timers of a silent key clear it too."""

    OUTPUT = "user_id long, event_id long"

    def __init__(self, small: float, large: float, timeout_ms: int, expire: bool = False):
        self.small, self.large, self.timeout, self.expire = small, large, timeout_ms, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flag = handle.getValueState("flag", "up boolean")
        self.due = handle.getListState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        up = bool(self.flag.exists() and self.flag.get()[0])
        due = sorted(r[0] for r in self.due.get())
        for row in sorted(rows, key=lambda r: r.ts):
            at = _ms(row.ts)
            while due and due[0] <= at:
                due.pop(0)
                up = False
            if up and row.value > self.large:
                yield Row(user_id=key[0], event_id=row.event_id)
            if row.value < self.small:
                up = True
                due.append(at + self.timeout)
                if self.expire:
                    self.handle.registerTimer(at + self.timeout)
        self._keep(up, due)

    def _keep(self, up: bool, due: list[int]) -> None:
        if due:
            self.flag.update((up,))
            self.due.put([(x,) for x in due])
        else:  # the flag is up only while a timer is pending
            self.flag.clear()
            self.due.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(r[0] for r in self.due.get())
        self._keep(bool(self.flag.exists() and self.flag.get()[0]) and (not due or due[0] > now), [x for x in due if x > now])
        return iter(())

    def close(self) -> None:
        pass


class CountOrTime(StatefulProcessor):
    """Batches of a key: out when ``size`` rows are there, or ``wait_ms`` after the first of them.

    ``key`` names the key column and its type, ``ident`` the long column whose values a batch lists.
    With ``processing`` the wait is of processing time, for groups in that mode."""

    def __init__(self, size: int, wait_ms: int, key: str = "user_id long", ident: str = "event_id", processing: bool = False):
        self.size, self.wait, self.key, self.ident, self.processing = size, wait_ms, key.split()[0], ident, processing
        self.OUTPUT = f"{key}, n long, ids string, by string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "event_id long")
        self.timer = handle.getValueState("timer", "at long")

    def _drop_timer(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [r[0] for r in self.rows.get()]
        for row in sorted(rows, key=lambda r: r.ts):
            if not held:
                at = (timerValues.getCurrentProcessingTimeInMs() if self.processing else _ms(row.ts)) + self.wait
                self.handle.registerTimer(at)
                self.timer.update((at,))
            held.append(row[self.ident])
            if len(held) >= self.size:
                self._drop_timer()
                yield Row(**{self.key: key[0]}, n=len(held), ids=",".join(map(str, held)), by="count")
                held = []
        if held:
            self.rows.put([(x,) for x in held])
        else:
            self.rows.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = [r[0] for r in self.rows.get()]
        self.rows.clear()
        self.timer.clear()
        if held:
            yield Row(**{self.key: key[0]}, n=len(held), ids=",".join(map(str, held)), by="time")

    def close(self) -> None:
        pass


class LateRouter(StatefulProcessor):
    """Every row with ``late``: its tumbling window plus the allowed lateness ended before the
    key's largest earlier time less the delay. The two outputs are filters on ``late``."""

    OUTPUT = "key string, event_id long, late boolean"

    def __init__(self, size_ms: int, delay_ms: int, allowed_ms: int = 0):
        self.size, self.delay, self.allowed = size_ms, delay_ms, allowed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        high = self.high.get()[0] if self.high.exists() else None
        for row in sorted(rows, key=lambda r: r.arrival):
            at = _ms(row.ts)
            end = at - at % self.size + self.size - 1 + self.allowed
            yield Row(key=key[0], event_id=row.event_id, late=high is not None and end <= high - self.delay)
            high = at if high is None else max(high, at)
        self.high.update((high,))

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """The first row of each value of a key; values are forgotten after ``ttl_ms`` of processing time."""

    OUTPUT = "key string, value string"

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "n long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            value = (str(row.value),)
            if not self.seen.containsKey(value):
                self.seen.updateValue(value, (1,))
                yield Row(key=key[0], value=value[0])

    def close(self) -> None:
        pass


class LatestConfig(StatefulProcessor):
    """For tagged rows of two streams (``jobs.connected``): each data row with the key's config that
    came last before it, or the default. With ``ttl_ms`` (processing-time mode) configs are forgotten."""

    OUTPUT = "key string, event_id long, config string"

    def __init__(self, default: str, ttl_ms: int | None = None):
        self.default, self.ttl = default, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.config = handle.getValueState("config", "value string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.config.get()[0] if self.config.exists() else None
        for row in sorted(rows, key=lambda r: (r.ts, r.data is not None)):
            if row.data is None:
                now = row.config
            else:
                yield Row(key=str(key[0]), event_id=row.data["event_id"], config=self.default if now is None else now)
        if now is not None:
            self.config.update((now,))

    def close(self) -> None:
        pass


class CountAndTime(StatefulProcessor):
    """Windows of a key that fire at every ``size`` rows, ``interval_ms`` after the first row since the
    last firing, and at their end, where their state goes: ``operators.triggers`` on a stream.

    Timers that are due before a row's time fire before the row, so results do not depend on
    micro-batches. Group by the key; event-time mode."""

    def __init__(self, size: int, interval_ms: int, window_ms: int, key: str = "user_id long"):
        self.make = (size, interval_ms, window_ms)
        self.key = key.split()[0]
        self.OUTPUT = f"{key}, window_end long, fired_at long, n long, n_new long, cause string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "until long, total long, new long, due long")

    def _core(self):
        from ..operators.triggers import CountAndTimeWindow

        core = CountAndTimeWindow(*self.make)
        if self.state.exists():
            core.until, core.total, core.new, due = self.state.get()
            core.due = None if due < 0 else due
        return core

    def _keep(self, core) -> None:
        if core.until is None:
            self.state.clear()
            return
        self.state.update((core.until, core.total, core.new, -1 if core.due is None else core.due))
        self.handle.registerTimer(core.until)
        if core.due is not None and core.due < core.until:
            self.handle.registerTimer(core.due)

    def _rows(self, key, fired) -> Iterator[Row]:
        for end, at, n, new, cause in fired:
            yield Row(**{self.key: key[0]}, window_end=end, fired_at=at, n=n, n_new=new, cause=cause)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        core, fired = self._core(), []
        for row in sorted(rows, key=lambda r: r.ts):
            fired += core.row(_ms(row.ts), 0)
        self._keep(core)
        yield from self._rows(key, fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        core = self._core()
        fired = core.advance(expiredTimerInfo.getExpiryTimeInMs())
        if fired:
            self._keep(core)
        yield from self._rows(key, fired)

    def close(self) -> None:
        pass


class Reduced(StatefulProcessor):
    """A running sum, least or largest value of each key, with the value so far for each row."""

    OUTPUT = "key string, event_id long, value double"

    def __init__(self, how: str):
        if how not in ("sum", "min", "max"):
            raise ValueError("how must be sum, min or max")
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fold = {"sum": lambda a, b: a + b, "min": min, "max": max}[self.how]
        now = self.held.get()[0] if self.held.exists() else None
        for row in sorted(rows, key=lambda r: r.event_id):
            now = row.value if now is None else fold(now, row.value)
            yield Row(key=str(key[0]), event_id=row.event_id, value=now)
        if now is not None:
            self.held.update((now,))

    def close(self) -> None:
        pass


class DayUsers(StatefulProcessor):
    """Distinct users of each day; when the watermark closes a day, its users roll into the history and go.

    Rows have day (epoch days) and user; emits per closed day: users known before it, new on it.
    Event-time mode, grouped by a slot of the users' hash, whose counts add up."""

    OUTPUT = "slot long, day long, known long, cur_new long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "user long", "day long")
        self.days = handle.getMapState("days", "day long", "fresh long")
        self.known = handle.getValueState("known", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: r.ts):
            if not self.days.containsKey((row.day,)):
                self.days.updateValue((row.day,), (0,))
                self.handle.registerTimer((row.day + 1) * 86_400_000)
            if not self.first.containsKey((row.user,)):
                self.first.updateValue((row.user,), (row.day,))
                self.days.updateValue((row.day,), (self.days.getValue((row.day,))[0] + 1,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        day = expiredTimerInfo.getExpiryTimeInMs() // 86_400_000 - 1
        known = self.known.get()[0] if self.known.exists() else 0
        fresh = self.days.getValue((day,))[0]
        yield Row(slot=key[0], day=day, known=known, cur_new=fresh)
        self.days.removeKey((day,))  # the hook at purge: today's users are history now
        self.known.update((known + fresh,))

    def close(self) -> None:
        pass


class RepeatedThen(StatefulProcessor):
    """``a+ b`` of a key on a stream, strictly consecutive, under a skip strategy: ``operators.patterns``.

    Holds the run of ``a`` that is open. Matches are (first id, last id, length)."""

    OUTPUT = "key long, first_id long, last_id long, n long"

    def __init__(self, a: str, b: str, strategy: str = "NO_SKIP"):
        self.a, self.b, self.strategy = a, b, strategy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getListState("run", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        from ..operators.patterns import one_or_more_then

        ids = [r[0] for r in self.run.get()]
        for row in sorted(rows, key=lambda r: r.event_id):
            if row.behavior == self.a:
                ids.append(row.event_id)
                continue
            if row.behavior == self.b and ids:
                for m in one_or_more_then([self.a] * len(ids) + [self.b], self.a, self.b, self.strategy):
                    yield Row(key=key[0], first_id=ids[m[0]], last_id=row.event_id, n=len(m))
            ids = []
        if ids:
            self.run.put([(x,) for x in ids])
        else:
            self.run.clear()

    def close(self) -> None:
        pass
