import re

import pytest

from tidewater.llm import mixing


def fill(sizes, weights, cap):
    """Water-filling as stated: share, clamp, share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return share | fixed
        fixed |= {s: cap * sizes[s] for s in over}


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    target = fill(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS) if sizes else {}
    by_id = {(d, size_of(t)): s for d, t, s in rows}  # ids are not shared by sources here
    assert len(got) == len(rows)
    taken, largest = {}, {}
    for r in got:
        source = by_id[(r.doc_id, r.size)]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] = taken.get(source, 0) + r.taken
        largest[source] = max(largest.get(source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_odd_rows(spark):
    rows = [(k, "w " * (k % 13), f"s{k % 5}") for k in range(400)]
    rows += [(1000, None, None), (1001, "a b\x0bc\x0cd", None), (1002, "", "empty"), (1003, "x " * 40000, "ä"), (1004, "y", "Z"), (7, "w " * 7, "s2")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.mix_plan(df).collect()
    check(rows, got)
    again = mixing.mix_plan(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_one_source_and_none(spark):
    rows = [(k, "a b c", "only") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mixing.mix_plan(df).collect())
    assert mixing.mix_plan(df.limit(0)).collect() == []
    assert mixing.mixed(df).count() == 50


def test_hot_source_is_cut_inside_a_bucket(spark):
    rows = [(k, "a " * (1 + k % 9), "s0") for k in range(3000)] + [(5000 + k, "b c", f"t{k % 8}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mixing.mix_plan(df, buckets=4).collect())


def test_shared_ids_and_clashing_names(spark):
    """Twenty ids are used by two sources; the mix keeps to each source's target, by rows of the result."""
    rows = [(k % 60 if k % 5 else None, "w " * (1 + k % 13) + f"{k // 60}", f"s{k % 3}") for k in range(900)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, h int, row int, k_ int, n_copies_ int")
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    target = fill(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    got, taken = mixing.mixed(df.repartition(7)), {}
    assert got.columns == df.columns
    for r in got.collect():
        assert (r.doc_id, r.text, r.source) in set(rows) and (r.h, r.row, r.k_, r.n_copies_) == (1, 2, 3, 4)
        taken[r.source] = taken.get(r.source, 0) + size_of(r.text)
    assert all(abs(taken[s] - target[s]) <= 8 for s in target)


def test_sample_that_ends_inside_a_group_of_copies(spark):
    rows = [(7, "a b c d", "hot")] * 500 + [(None, "x y", "hot")] * 300 + [(k, "q r s", "cold") for k in range(40)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, source string, n int").repartition(6)
    target = fill({"hot": 2600, "cold": 120}, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    plan = [mixing.mix_plan(d, buckets=2).collect() for d in (df, df.repartition(3))]
    assert sorted(map(str, plan[0])) == sorted(map(str, plan[1])) and len(plan[0]) == len(rows)
    for source in target:
        assert abs(sum(r.taken for r in plan[0] if r.source == source) - target[source]) <= 2
    ids = [r.n for r in mixing.mixed(df, buckets=2).collect()]
    assert len(ids) == sum(r.copies for r in plan[0]) and max(map(ids.count, set(ids))) <= 3


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(rows, mixing.op4_mix_sources(spark, sf).collect())
