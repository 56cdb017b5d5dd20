import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.planted import corpus
from tidewater.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(m):
    d = [int(c) for c in m if c.isascii() and c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def base(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            n = sum(c.isdigit() for c in m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= n <= 19 and luhn(m[0])) or kind == "phone" and not 10 <= n <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def shown(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def compare(spark, texts):
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, start int")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for k, t in enumerate(texts):
        assert [tuple(s) for s in got[k].strict] == base(t), t
        assert {tuple(s) for s in got[k].strict} <= {tuple(s) for s in got[k].spans}
        assert all(0 <= s.start < s.end <= len(t or "") for s in got[k].spans)


ODD = [
    None,
    "",
    "a@b.c_d@e.f x@y.z.. @a.b a@b a@b. é@x.é",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0000255.1.01.0 9.9.9.99999999999999999999",
    "4111 1111 1111 1111 4111111111111112 5500-0000-0000-0004 1 2 3",
    "+1 (976) 555-9947 +12345 +1((((( +1 2 3 4 5 6 7 8 9 0) ++49301234567",
    "😀 call 212-555-0123 or me[at]host.com, x (at) y (dot) org",
    "x" * 6000 + "@b.c",
    "7" * 6000,
    "1.2.3.4 " * 800,
    "a.b@" + "c." * 4000 + "d",
]


def test_very_long_runs(spark):
    """Linear in the length: the brute force of these tests would take minutes."""
    texts = ["x" * 200000 + "@b.c", "7" * 150000, "1.2.3.4 " * 5000, "a.b@" + "c." * 50000 + "d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.strict] for r in pii.personal_data(df).collect()}
    assert got[0] == [(0, 0, 200004)] and got[1] == [] and got[3] == [(0, 0, 100005)]
    assert got[2] == [(8 * k, 1, 8 * k + 7) for k in range(5000)]


def test_strict_spans_on_odd_texts(spark):
    compare(spark, ODD)


def test_cards_with_every_digit_separated(spark):
    """No two digits are adjacent anywhere in these texts."""
    card = "4111111111111111"
    texts = ["card " + " ".join(card), "-".join(card), "4-1 1-" + " ".join(card[3:]) + " x", "4.1 1", "1 2 3"]
    assert [len(base(t)) for t in texts] == [1, 1, 1, 0, 0]
    compare(spark, texts)


def test_strict_spans_on_random_texts(spark):
    import random

    rnd = random.Random(5)
    compare(spark, ["".join(rnd.choice("0123456789.@+- ()ab_é1122") for _ in range(rnd.randint(0, 90))) for _ in range(1500)])


def test_whole_table_and_empty(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op5_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        b = base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(shown(b).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in b) for k in range(4))
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_planted_spans_beyond_the_strict_ones(spark):
    texts, planted = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    true = found = right = 0
    kinds = set()
    for r in pii.personal_data(df).collect():
        extra = {(pii.ALL_KINDS[s.kind], s.start, s.end) for s in r.spans} - {(pii.ALL_KINDS[s.kind], s.start, s.end) for s in r.strict}
        assert [tuple(s) for s in r.strict] == base(texts[r.doc_id])
        true, found, right = true + len(planted[r.doc_id]), found + len(extra), right + len(extra & planted[r.doc_id])
        kinds |= {s[0] for s in extra & planted[r.doc_id]}
        assert all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:]))
    assert right >= 0.9 * true and right >= 0.9 * found, (right, true, found)
    assert kinds == {"email", "card", "phone", "secret"}


def test_more_than_the_base_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op5_pii(spark, "/root/testdata/sf0.01").collect()
    extra = [(docs[r.doc_id], *s.split(":")) for r in rows for s in r.spans.split(",") if s and s not in shown(base(docs[r.doc_id])).split(",")]
    assert extra
    for text, kind, a, b in extra:
        a, b = int(a), int(b)
        if kind == "secret":
            assert re.search(r"(?i)token = .$", text[:a]), text[a - 20 : b]
        else:
            assert kind != "card" or luhn(text[a:b])
    secrets = sum(len(re.findall(r"(?i)token = .[0-9a-f]{40}", t or "")) for t in docs.values())
    assert sum(k == "secret" for _, k, _, _ in extra) >= 0.9 * secrets


def test_em_finds_the_reliable_labeler():
    counts = [(0, (1, 1, 0, 1), 900), (0, (1, -1, 0, 1), 50), (0, (-1, 1, 0, -1), 400), (0, (-1, -1, 0, -1), 500)]
    post, rates = pii.reliabilities(counts)
    assert post[0, (1, 1, 0, 1)] > 0.95 and post[0, (-1, -1, 0, -1)] < 0.05
    assert rates[0][0][0] > rates[0][0][1]
    weight = pii.classifier([(k, v, [1]) for k, v, n in counts for _ in range(n // 50)], post)
    score = lambda v: sum(weight.get(x, 0) for x in pii.features(0, v, [1]))
    assert score((1, 1, 0, 1)) > 2 > -2 > score((-1, -1, 0, -1))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.tuples(*[st.sampled_from((-1, 0, 1))] * 4), st.integers(1, 10**9)), max_size=20))
def test_em_is_finite(counts):
    post, _ = pii.reliabilities(counts)
    assert all(0 <= p <= 1 for p in post.values())
