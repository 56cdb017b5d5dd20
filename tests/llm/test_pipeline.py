from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_mixing import fill, size_of
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_tokens import expected as tokenized
from tidewater.llm import mixing
from tidewater.llm.common import table, written
from tidewater.llm.toxicity import fit, score_ids


def test_each_stage_on_its_own_input(spark, sf):
    docs = written(table(spark, sf, "documents"), "docs")
    columns = docs.columns
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, sf), "out")
        before, after = rows(docs), rows(out) if "text" in out.columns else None
        if name != "token_binary":
            assert out.columns == columns
            assert set(after) <= set(before) and after
        if name == "ngram_jaccard":
            comps = components(before, 5, 80)
            assert after == sorted((d, t) for d, t in before if comps[d][1] == d)
        if name == "decontamination":
            items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
            hit = {r[0] for r in contaminated(before, items) if r[5]}
            assert after == [r for r in before if r[0] not in hit]
        if name == "toxicity":
            score = {r.doc_id: r.score for r in score_ids(docs, fit(docs, table(spark, sf, "labels"))).collect()}
            assert after == [r for r in before if score[r[0]] < 0.5] and len(after) < len(before)
        if name == "mixing":
            assert max(after.count(r) for r in set(after)) <= 3
            own = {r.doc_id: r.source for r in docs.collect()}
            sizes, taken, largest = Counter(), Counter(), Counter()
            for d, t in before:
                sizes[own[d]] += size_of(t)
                largest[own[d]] = max(largest[own[d]], size_of(t))
            for d, t in after:
                taken[own[d]] += size_of(t)
            for source, target in fill(dict(sizes), mixing.WEIGHTS, mixing.MAX_EPOCHS).items():
                assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6
        if name == "token_binary":
            assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == tokenized(before)
        docs = out


def test_repeated_rows_and_missing_ids(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(5, text, "en", "s", 1), (5, text, "en", "s", 1), (7, text + " x", "en", "s", 1), (None, text, "en", "s", 1), (9, None, None, None, None)], schema)
    got = cp.ngram_jaccard(spark, docs, sf)
    assert got.schema == docs.schema
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["5", "9", "None"]
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_clashing_columns_pass_through(spark, sf):
    names = ["id_", "rows_", "k_", "n_copies_", "row", "found", "n", "h", "at", "size", "component_id", "text__", "score__", "t", "c0", "a.b"]
    docs = table(spark, sf, "documents").withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, sf), "out")
        assert out.columns == docs.columns, name
        assert [tuple(r) for r in out.select(*[f"`{c}`" for c in names]).distinct().collect()] == [tuple(range(len(names)))]
        docs = out
    assert cp.token_binary(spark, docs, sf).count() == docs.count()
