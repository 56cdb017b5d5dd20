"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

A text is normalised to lower-case words (ASCII letters and digits and everything
outside ASCII) joined by single spaces. Each item gives windows of ``n`` consecutive
words, or one window of all its words if it has fewer; the automaton holds every
window once and each text is scanned once. Positions in the normalised text are
mapped back to words and to code points of the original.

Defined cases: a null or wordless text has no words and no hits; items that are null
or without words never occur; repeated items count once per item id and a null id
counts as the item ``null``; repeated documents are scanned each on its own; extra
columns are ignored; empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, held, scratch, table, with_text, written

#: Characters of item text for which one automaton is built (about 4 million states of a worker's
#: memory); a larger benchmark is scanned in passes that follow one another.
PASS_CHARS = 400_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SCAN = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text", pa.string()),
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
    ]
)
_OUT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows(items: list[tuple[str | None, str | None]], n: int) -> dict[str, list[str]]:
    """Window text -> ids of the items that have it."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            found.setdefault((b" " + b" ".join(w[k : k + n]) + b" ").decode("latin-1"), set()).add("null" if item is None else item)
    return {k: sorted(v) for k, v in found.items()}


def _automaton(shared):
    """One automaton per broadcast and worker process."""

    def build():
        import ahocorasick

        auto = ahocorasick.Automaton()
        for k, v in shared.value.items():
            auto.add_word(k, (k.count(" ") - 1, tuple(v)))
        if len(auto):
            auto.make_automaton()
        return auto

    return held(("automaton", shared.id_), build)


class _Shared:
    """A broadcast with a stable key for the per-process cache."""

    def __init__(self, broadcast, id_):
        self.broadcast, self.id_ = broadcast, id_

    @property
    def value(self):
        return self.broadcast.value


def _hits(auto, joined: bytes) -> tuple[list[int], set[str]]:
    """Flat [first, last+1, ...] word ranges and the items found."""
    spaces, ranges, items = None, [], set()
    for end, (length, ids) in auto.iter(joined.decode("latin-1")):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        last = int(np.searchsorted(spaces, end))
        if ranges and ranges[-2] <= last - length <= ranges[-1] <= last:
            ranges[-1] = last
        else:
            ranges += [last - length, last]
        items.update(ids)
    return ranges, items


def _scan(shared):
    def run(batches):
        auto = _automaton(shared)
        for batch in batches:
            names = batch.schema.names
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            before = batch.column(names.index("hits")).to_pylist() if "hits" in names else [None] * len(ids)
            others = batch.column(names.index("items")).to_pylist() if "items" in names else [None] * len(ids)
            counts, hits, found = [], [], []
            for text, h, i in zip(texts, before, others):
                w = words_of(text)
                r, s = _hits(auto, b" " + b" ".join(w) + b" ") if w and len(auto) else ([], set())
                counts.append(len(w))
                hits.append((h or []) + r)
                found.append(sorted(s.union(i or [])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], schema=_SCAN)

    return run


def _merged(flat: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _spans(text: str, ranges: list[list[int]]) -> list[dict]:
    """Code point ranges in the original text of the word ranges."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    point = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(point[edge[2 * a]]), "end": int(point[edge[2 * b - 1]])} for a, b in ranges]


def _finish(batches):
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    for batch in batches:
        hits = [_merged(h or []) for h in batch.column(3).to_pylist()]
        spans = [_spans(batch.column(1)[k].as_py(), h) if h else [] for k, h in enumerate(hits)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([sum(b - a for a, b in h) for h in hits], pa.int64()), batch.column(4), pa.array(spans, out.field(4).type)], schema=out)


def _chained(*steps):
    def run(batches):
        for step in steps:
            batches = step(batches)
        yield from batches

    return run


def _free(shared, at: int, columns: int):
    """The first ``columns`` of the rows whose text, the column ``at``, has no window."""

    def run(batches):
        auto = _automaton(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some, clear = batch.slice(lo, SLICE), []
                for text in some.column(at).to_pylist():
                    w = words_of(text)
                    clear.append(not (w and len(auto)) or next(auto.iter((b" " + b" ".join(w) + b" ").decode("latin-1")), None) is None)
                yield some.select(list(range(columns))).filter(pa.array(clear, pa.bool_()))

    return run


def _passes(spark: SparkSession, benchmark: DataFrame, n: int, pass_chars: int):
    """Broadcast windows of one hash share after the other, each of about ``pass_chars`` characters of items.

    A share is collected and sent only when the scan before it has ended and its broadcast is gone, so
    driver and workers hold one share at a time. Yields (shared, whether it is the last)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-int(total) // pass_chars))
    if count > 1:  # the benchmark is dealt by share once, so that a pass reads its own share only
        items = items.withColumn("share", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
        path = scratch(spark, "shares")
        items.repartition(min(count, 200), "share").write.partitionBy("share").parquet(path)
    for k in range(count):
        share = items if count == 1 else spark.read.schema("item_id string, text string, share long").parquet(path).where(F.col("share") == k).select("item_id", "text")
        broadcast = spark.sparkContext.broadcast(windows([tuple(r) for r in share.toLocalIterator()], n))
        yield _Shared(broadcast, uuid.uuid4().hex), k == count - 1
        if k < count - 1:
            broadcast.unpersist(blocking=True)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, pass_chars: int = PASS_CHARS) -> DataFrame:
    """Per document: words, words inside any window, items found, spans in the original.

    The benchmark is the stated query set and its size is summed first. Up to ``pass_chars`` characters
    it is one automaton and each text is scanned once, without a shuffle. A larger one, of which no
    worker could hold the automaton, is scanned share by share: the hits of each pass are written
    with the texts before the next automaton is built. The result is the same.
    """
    cur = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for shared, last in _passes(docs.sparkSession, benchmark, n, pass_chars):
        if last:
            return cur.mapInArrow(_chained(_scan(shared), _finish), _OUT)
        cur = written(cur.mapInArrow(_scan(shared), "doc_id long, text string, n_words long, hits array<long>, items array<string>"), "scanned")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with all their columns; no shuffle."""
    cur = docs
    for shared, last in _passes(docs.sparkSession, benchmark, n, pass_chars):
        rows, schema, at = with_text(cur)
        cur = rows.mapInArrow(_free(shared, at, len(schema)), schema).toDF(*docs.columns)
        if last:
            return cur
        cur = written(cur, "scanned")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
