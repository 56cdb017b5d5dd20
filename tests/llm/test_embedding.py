import math

import numpy as np

from tidewater.llm import embedding


def brute(rows, t=0.95):
    ok = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    parent, count = {i: i for _, i, _ in ok}, [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (k, i, x) in enumerate(ok):
        for m, j, y in ok[:p]:
            if len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= t:
                count[k] += 1
                count[m] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, count[k], find(i) if i in parent and count[k] >= 0 and any(q[0] == k for q in ok) else i) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, dim int").repartition(4)
    out = embedding.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def clustered(seed, n, dim):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    x = centers[rng.integers(12, size=n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.2, 0.3, 2.0], size=(n, 1))
    x[::9] = x[0]
    x[4] = 3 * x[5]
    return [(int(k * 2 + 1), [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]


def test_against_brute_force(spark):
    rows = clustered(1, 700, 16)
    assert run(spark, rows, interval=40) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, -0.0]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-30, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, -0.0])]
    got = run(spark, rows)
    assert got == sorted([(1, 3, 1), (2, 3, 1), (2, 3, 1), (10, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (11, 0, 11), (None, 0, None)], key=str)
    assert run(spark, []) == []


def test_small_tiles_and_chunks(spark):
    rows = clustered(2, 500, 8)
    assert run(spark, rows, interval=20, tile=2, chunks=4) == brute(rows)
    assert run(spark, rows, interval=500, tile=1, chunks=1) == brute(rows)


def test_distant_intervals_are_skipped():
    low = np.array([[k, 0.0] for k in range(100)])
    run_ = (np.full(100, 2), low, low + 0.5)
    pairs = {(int(i), int(j)) for x, y in embedding.near_pairs(run_, None, 0.6, leaf=4) for i, j in zip(x, y)}
    assert pairs == {(k, k) for k in range(100)} | {(k, k + 1) for k in range(99)}


def test_recursion_finds_every_near_pair():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, m = rng.integers(1, 60, 2)
        runs = []
        for size in (n, m):
            low = rng.normal(size=(size, 3))
            runs.append((np.sort(rng.integers(2, 4, size)), low, low + rng.random((size, 3)) / 3))
        gap = lambda a, b: sum(max(0, a[1][k] - b[2][k], b[1][k] - a[2][k]) ** 2 for k in range(3))
        for right in (None, runs[1]):
            other = runs[0] if right is None else right
            one, two = list(zip(*runs[0])), list(zip(*other))
            want = {(i, j) for i, a in enumerate(one) for j, b in enumerate(two) if a[0] == b[0] and gap(a, b) <= 0.16 + 1e-9 and (right is not None or i <= j)}
            got = [tuple(sorted((int(i), int(j)))) if right is None else (int(i), int(j)) for x, y in embedding.near_pairs(runs[0], right, 0.4, leaf=3) for i, j in zip(x, y)]
            assert len(got) == len(set(got)) and set(got) == want


def test_packing_loses_nothing():
    for values in ([1.0, 0.5, np.float64(np.float32(0.1))], [0.1, 1.0, 1e300]):
        raw = np.array(values).tobytes()
        assert embedding._unpacked(embedding._packed([raw]), 1, 3).tobytes() == raw


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding.op9_embedding_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows)
