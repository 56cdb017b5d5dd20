import random

import pytest

from tidewater.llm import common


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def graphs():
    rnd = random.Random(3)
    yield []
    yield [(1, 2)]
    yield [(-k, -k - 1) for k in range(60)]  # a path
    yield [(0, k) for k in range(1, 200)] + [(500, k) for k in range(501, 700)] + [(199, 501)]  # two hubs, joined
    yield [(rnd.randrange(300) * 7, rnd.randrange(300) * 7 + 1) for _ in range(280)]
    for _ in range(4):
        yield [(rnd.randrange(400), rnd.randrange(400)) for _ in range(rnd.choice((100, 190, 300)))]


@pytest.mark.parametrize("task_edges", [0, 50, common.TASK_EDGES])
def test_components(spark, task_edges):
    for edges in graphs():
        rows = [*edges, (None, 5), (5, None), (None, None), (77, 77)]
        df = spark.createDataFrame(rows, "a long, b long").repartition(3)
        got = common.components(df, task_edges=task_edges).collect()
        assert sorted((r.id, r.comp) for r in got) == brute([e for e in edges if e[0] != e[1]])


def test_scratch_and_cleanup(spark):
    path = common.scratch(spark, "x")
    assert path.startswith("file:") and path != common.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    held = common._made[:]
    try:
        common._made[:] = [path]
        assert common.cleanup(spark) == 1 and common.cleanup(spark) == 0
        with pytest.raises(Exception, match="(?i)path"):
            spark.read.parquet(path)
    finally:
        common._made[:] = held


class _Session:
    """What scratch asks of a session."""

    def __init__(self, real, master, base):
        self.conf = {"spark.checkpoint.dir": base} if base else {}
        self.sparkContext = type("Context", (), {"master": master, "_jsc": real.sparkContext._jsc})()


def test_where_scratch_is(spark):
    at = lambda master, base: common.scratch(_Session(spark, master, base), "x")
    assert at("spark://h:1", "/shared").startswith("file:///shared/x-")  # the default file system of these tests
    assert at("spark://h:1", "hdfs://n/shared/").startswith("hdfs://n/shared/x-")
    own = at("local[2]", None)
    assert own.startswith("file:///") and own.rpartition("/")[0] == at("local", None).rpartition("/")[0]
    with pytest.raises(RuntimeError):
        at("spark://h:1", None)


def test_texts_go_to_the_workers_once(spark):
    """A text of another type follows as a string; names that clash or have dots stay apart."""
    rows, schema, at = common.with_text(spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, `a.b` int"))
    assert (rows.columns, schema.names, at) == (["c0", "c1", "c2"], ["c0", "c1", "c2"], 1)
    rows, schema, at = common.with_text(spark.createDataFrame([(7, 5, 6)], "text int, n long, `a.b` long"))
    assert (rows.columns, schema.names, at) == (["c0", "c1", "c2", "t"], ["c0", "c1", "c2"], 3)
    assert [tuple(r) for r in rows.collect()] == [(7, 5, 6, "7")]


def test_rows_come_back_in_small_batches():
    import pyarrow as pa

    from tidewater.llm import decontam

    class Shared:
        id_, value = "test", {" bad word ": ["1"]}

    texts = ["good words", "a bad word here", None] * 700
    batch = pa.RecordBatch.from_pydict({"c0": list(range(2100)), "c1": texts, "t": texts})
    out = list(decontam._free(Shared, 1, 2)([batch]))
    assert max(b.num_rows for b in out) <= 512 and out[0].schema.names == ["c0", "c1"]
    assert [x for b in out for x in b.column(0).to_pylist()] == [k for k in range(2100) if k % 3 != 1]
