import hashlib
import re

import pytest

from tidewater.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items):
    pats = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            pats.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(p) for p in pats}
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := pats.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


LONG = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, LONG), (10, "Foo, bar!"), (2, "foo bar"), (3, None), (4, "--"), (5, "é ü"), (6, "a a a"), (7, "a a")]
DOCS = [(1, LONG.upper().replace(" ", "--\n")), (2, "x " + LONG[4:] + " y"), (3, None), (4, ""), (5, "foobar foo bar foo bar"), (6, "É ü é ü"), (7, "a a a a b a"), (8, "one two three four five six seven eight nine"), (9, "z " * 40000 + "Foo_Bar")]


@pytest.mark.parametrize("size", [400_000, 30])
def test_odd_texts(spark, size):
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, items string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.decontaminate(docs, items, pass_chars=size).collect()
    got = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), r.n_hit > 0) for r in rows)
    assert got == brute(DOCS, ITEMS)
    texts = dict(DOCS)
    for r in rows:
        assert sum(len(WORD.findall(low(texts[r.doc_id])[s.start : s.end])) for s in r.spans) == r.n_hit
    free = decontam.uncontaminated(docs, items, pass_chars=size)
    assert free.schema == docs.schema and sorted(r.doc_id for r in free.collect()) == [r[0] for r in brute(DOCS, ITEMS) if not r[5]]


def test_passes_hold_one_broadcast_at_a_time(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    live, most, made = set(), [], spark.sparkContext.broadcast
    gone = Broadcast.unpersist

    def broadcast(value):
        b = made(value)
        live.add(id(b))
        most.append(len(live))
        return b

    def unpersist(b, blocking=False):
        live.discard(id(b))
        return gone(b, blocking)

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "unpersist", unpersist)
    docs = spark.createDataFrame([(d, t) for d, t in DOCS], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.decontaminate(docs, items, pass_chars=20).count() == len(DOCS)
    assert len(most) > 3 and max(most) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.decontaminate(docs, items).collect()] == [0]
    assert decontam.decontaminate(docs.limit(0), items).collect() == []


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, decontam.op3_benchmark_decontamination(spark, sf).collect())) == brute(docs, items)
