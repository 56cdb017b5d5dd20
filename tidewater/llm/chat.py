"""Chat formatting into budgeted windows of whole turns.

Template, one turn: ``<|turn|>role<|text|>text<|end|>``; a turn that a window repeats
starts with ``<|again|>`` instead. Inside roles and texts a backslash follows every
``<`` and ``[``, so none of ``<|...|>``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]`` can
occur there; reading takes those backslashes away again.

Windows: prefix sums of the turns' tokens choose the longest span of whole new turns
that fits the budget; a leading system turn is repeated in each window; the last turns
before the span are repeated while they fit ``history`` tokens. Only assistant texts
that are new in a window are under its loss mask, so each is learned once.

Defined cases: null texts and roles are empty; a turn above the budget gets a window
of its own; rows are ordered by turn (nulls first), then role and text, and repeated
rows are turns each; a null conv_id is a conversation; an empty table gives no rows;
extra columns are ignored. A conversation of any length, that of all rows without a conv_id
included, is one task's work but streamed: the task holds the turns of one window and its history.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BUDGET = 2048
HISTORY = 256
_TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return text.replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return text.replace("<\\", "<").replace("[\\", "[")


def turn_tokens(text: str) -> int:
    """Tokens of a turn with its four marks; any additive count can take this one's place."""
    return sum(1 for _ in _TOKEN.finditer(text)) + 4


class _Windows:
    """Turns of one conversation in, windows out."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.system_tokens = None, 0
        self.past: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str]] = []
        self.sums = [0]
        self.first = True

    def _room(self) -> int:
        return self.budget - self.system_tokens - sum(n for _, _, n in self.past)

    def add(self, role: str, text: str):
        """A finished window if the turn does not fit any more."""
        n = turn_tokens(text)
        out = None
        if self.new and self.sums[-1] + n > self._room():
            out = self._close()
        if self.first and role == "system":
            self.system, self.system_tokens = (role, text), n
            self.first = False
            self.sums, self.new = [0, 0], [self.system]
            return out
        self.first = False
        while self.past and not self.new and n > self._room():
            self.past.pop(0)  # history gives way to a long turn
        self.new.append((role, text))
        self.sums.append(self.sums[-1] + n)
        return out

    def _close(self):
        parts, start, end, at, tokens = [], [], [], 0, self.sums[-1] + self.system_tokens
        repeated = [self.system] if self.system and self.new[0] is not self.system else []
        repeated += [(r, t) for r, t, _ in self.past]
        tokens += sum(n for _, _, n in self.past)
        for k, (role, text) in enumerate(repeated + self.new):
            again, body = k < len(repeated), escape(text)
            head = ("<|again|>" if again else "<|turn|>") + escape(role) + "<|text|>"
            if not again and role == "assistant":
                start.append(at + len(head))
                end.append(at + len(head) + len(body))
            parts += (head, body, "<|end|>")
            at += len(head) + len(body) + 7
        row = ("".join(parts), start, end, tokens, len(self.new))
        # the longest suffix of what was shown that fits the history
        shown = self.past + [(r, t, b - a) for (r, t), a, b in zip(self.new, self.sums, self.sums[1:]) if (r, t) is not self.system]
        shown = [x for x in shown if x[2]]
        tail = [0]
        for _, _, n in reversed(shown):
            tail.append(tail[-1] + n)
        keep = bisect_right(tail, self.history) - 1
        self.past = shown[len(shown) - keep :]
        self.new, self.sums = [], [0]
        return row

    def rest(self):
        return self._close() if self.new else None


_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("n_new", pa.int64())])
_WINDOW_SQL = "conv_id long, window long, text string, loss_start array<long>, loss_end array<long>, n_tokens long, n_new long"


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _format(budget: int, history: int):
    def run(batches):
        conv, state, k, rows = None, None, 0, []

        def put(row):
            nonlocal k
            if row:
                rows.append((conv, k, *row))
                k += 1

        for batch in batches:
            for c, role, text in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if state is None or c != conv:
                    if state is not None:
                        put(state.rest())
                    conv, state, k = c, _Windows(budget, history), 0
                put(state.add(role or "", text or ""))
                if len(rows) >= 256:
                    yield _batch(rows, _WINDOW)
                    rows = []
        if state is not None:
            put(state.rest())
        if rows:
            yield _batch(rows, _WINDOW)

    return run


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations, in order of conv_id and window within a partition.

    One shuffle by conversation; the order of turns comes from an external sort.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format(budget, history), _WINDOW_SQL)


_TURN = re.compile(r"<\|(turn|again)\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def parse(text: str) -> list[tuple[bool, str, str]]:
    """(new, role, text) of each turn of a formatted window."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("not a formatted window")
        out.append((m[1] == "turn", unescape(m[2]), unescape(m[3])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a formatted window")
    return out


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def _digests(batches):
    conv, held, rows = None, None, []

    def done():
        n, turns, chars, loss, size, windows = held
        rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, windows))

    for batch in batches:
        for c, text, start, end in zip(*(batch.column(j).to_pylist() for j in (0, 2, 3, 4))):
            if held is None or c != conv:
                if held is not None:
                    done()
                conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for new, role, body in parse(text):
                if new:
                    held[0] += 1
                    held[1].update(f"{role}\n{body}\n".encode())
            for a, b in zip(start, end):
                body = unescape(text[a:b])
                held[2] += len(body)
                held[3].update(body.encode())
            held[4] += len(text)
            held[5] += 1
        if len(rows) >= 1024:
            yield _batch(rows, _DIGEST)
            rows.clear()
    if held is not None:
        done()
    if rows:
        yield _batch(rows, _DIGEST)


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and loss text per conversation, as the formatted windows have them.

    A conversation's windows are digested in order, so they meet in one task, sorted on disk and streamed."""
    windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return windows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(written(format_chats(turns.unionByName(own)), "windows"))
