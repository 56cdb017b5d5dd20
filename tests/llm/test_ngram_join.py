import random
import re

import numpy as np
import pytest

from tidewater.llm import ngram_join as nj


def brute(rows, width=4, percent=85):
    """doc_id -> (set size, smallest id reachable)."""
    sets, parent = [], {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((doc, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
        parent[doc] = doc

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                o = len(x & y)
                if 100 * o >= percent * (len(x) + len(y) - o):
                    ra, rb = find(a), find(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {doc: (len(s), find(doc)) for doc, s in sets}


def corpus(seed, n=260):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    rows = []
    for doc in range(n):
        kind = rnd.random()
        if rows and kind < 0.5:
            w = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 6))):
                if w:
                    k = rnd.randrange(len(w))
                    w[k : k + rnd.randint(0, 1)] = [rnd.choice(vocab)]
        elif kind < 0.6:
            w = passage + [rnd.choice(vocab) for _ in range(rnd.randint(0, 25))]
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice((0, 1, 3, 4, 9, 12, 16, 20, 24, 30, 60, 200)))]
        rows.append((doc, " ".join(w).upper() if rnd.random() < 0.1 else " ".join(w)))
    return [(d * 3 + 5, t if t or d % 2 else None) for d, t in rows]


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df, **{"width": 4, "percent": 85, **options}).collect()}


@pytest.mark.parametrize("options", [{}, {"boundary": 0, "weight": 700}, {"boundary": 16}, {"weight": 1500, "part_keys": 40, "batch_docs": 7}])
def test_against_brute_force(spark, options):
    rows = corpus(len(options) + options.get("boundary", 3))
    assert run(spark, rows, **options) == brute(rows)


def test_five_words_and_four_fifths(spark):
    rows = corpus(8)
    assert run(spark, rows, width=nj.WIDTH, percent=nj.PERCENT) == brute(rows, 5, 80) != brute(rows)


def test_thousands_of_near_copies_and_long_text(spark):
    rnd = random.Random(9)
    base = [f"v{rnd.randrange(10**6)}" for _ in range(60)]
    rows = []
    for doc in range(400):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(60)] = f"n{doc}x{rnd.randrange(9)}"
        rows.append((doc, " ".join(w)))
    rows += [(1000, "a b " * 60000), (1001, "a b " * 50000), (1002, "é\x0b\x0c z\x1cq")]
    assert run(spark, rows, weight=4000) == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None), (3, " ")], "doc_id long, text string")
    got = sorted(map(tuple, nj.jaccard_components(df, width=4, percent=85).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2), (3, 0, 3)], key=str)
    assert nj.jaccard_components(df.limit(0)).collect() == []


def test_heavy_classes_and_chains(spark):
    """Near copies in two families that share a passage, and chains in which only neighbours are similar."""
    rnd = random.Random(12)
    word = lambda: f"u{rnd.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    rows = []
    for family in range(2):
        base = passage + [word() for _ in range(14 + 6 * family)]
        for _ in range(150):
            w = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 4))):
                w[rnd.randrange(40, len(w))] = word()
            rows.append(w)
    chain = [word() for _ in range(60)]
    for _ in range(80):
        chain = chain[2:] + [word(), word()]
        rows.append(list(chain))
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    want = brute(rows)
    for weight in (900, 6000):
        assert run(spark, rows, weight=weight) == want
    assert len({c for _, c in want.values()}) > 3


def test_parts_are_ranges():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    for parts in (1, 7, 1 << 20):
        part = nj._part(keys, parts)
        assert (np.diff(part.astype(np.int64)) >= 0).all() and part.max() < parts
    assert (nj._keys(nj._planes(keys)) == keys).all()


def test_boundary_by_cost():
    assert nj.choose_boundary([(5, 5, 100), (8, 8, 100)], 85) >= 8
    assert nj.choose_boundary([]) == 0


def test_what_other_operators_keep_is_dropped(spark):
    """A worker that goes from one operator to the join keeps nothing of the former."""
    from tidewater.llm import common

    common.held(("other",), lambda: "model")
    with pytest.raises(AttributeError):  # no task here, so the documents are not reached
        next(nj._send(4, 5, "unused", 8)(iter([])))
    assert not common._held
