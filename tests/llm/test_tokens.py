import io
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import rans, tokens

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for t in texts]


def expected(rows):
    start, out = 0, []
    ids = library([r[1] for r in rows])
    for (doc, _), x in zip(rows, ids):
        out.append((doc, start, len(x), zlib.crc32(x.astype("<u4").tobytes())))
        start += len(x)
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=3000))
def test_coder_round_trip(ids):
    x = np.array(ids, np.uint32)
    coder = rans.Coder(*rans.table(x))
    if len(x):
        assert (coder.decode(len(x), *coder.encode(x)) == x).all()


def test_damage_is_seen():
    x = np.random.default_rng(1).integers(0, 500, 600_000).astype(np.uint32)
    raw = bytearray(tokens.shard_bytes([5], [len(x)], x))
    assert (tokens.read_shard(bytes(raw))[2] == x).all()
    raw[-100] ^= 1
    with pytest.raises(ValueError):
        tokens.read_shard(bytes(raw))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_chunks_give_the_ids_of_whole_texts(texts):
    got = tokens.encoder(PATH).ids(texts)
    assert got == [x[:-1].tobytes() for x in library(texts)]


def test_ids_of_letters_that_normalisation_changes():
    """Marks after letters whose lower case, or composed form, does not end in a letter."""
    rnd = random.Random(17)
    letters = "abHJTWI\u0331\u0308\u030c\u030aİıſKÅÀéßŉǅǰΐΣσςﬁĲŁ\u0301\u0307\u0327\u0345e\u0301ªº²½Ⅷ٣あ한\u1100\u1161"
    texts = ["İ,", "xİ.", "İ", "Iİ!?", "e\u0301,", "ſ.", "K,", "a\u0307'", "ŉ'", "é's", "İ's,", "H\u0331", "h\u0331.", "I\u0327\u0307,", "J\u030c", "T\u0308!"]
    texts += ["".join(rnd.choice(letters + ",.'!-’ \u00a0 ") for _ in range(rnd.randint(1, 12))) for _ in range(100_000)]
    coded = tokens.Encoder(PATH)
    for a in range(0, len(texts), 10_000):
        part = texts[a : a + 10_000]
        want = [np.array(e.ids, np.uint32).tobytes() for e in coded.tok.encode_batch(part, add_special_tokens=False)]
        wrong = [t for t, x, y in zip(part, coded.ids(part), want) if x != y]
        assert not wrong, wrong[:5]


def test_blocks_are_read_on_their_own(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 100)
    rnd = np.random.default_rng(3)
    lengths = [1, 250, 3, 99, 1, 1, 700, 46, 5]
    ids = rnd.integers(0, 50, sum(lengths)).astype(np.uint32)
    shard = tokens.Shard(io.BytesIO(tokens.shard_bytes(list(range(len(lengths))), lengths, ids)))
    whole = [(d, s, x.tolist()) for d, s, x in shard.documents()]
    ends = np.cumsum(lengths).tolist()
    assert whole == [(k, e - n, ids[e - n : e].tolist()) for k, (n, e) in enumerate(zip(lengths, ends))]
    for unit in (1, 2, 5):
        dealt = [(d, s, x.tolist()) for lo in range(0, len(shard.head["blocks"]), unit) for d, s, x in shard.documents(lo, lo + unit)]
        assert dealt == whole


ODD = [
    (3, "Hello  WORLD's it's <|endoftext|> x"),
    (1, None),
    (2, ""),
    (9, "a\x1cb\x85c d　e Σας ΣΑΣ İstanbul Á ́x ﬁ"),
    (5, "word " * 30000),
    (7, "x" * 50000),
]


def test_odd_texts_and_order(spark):
    df = spark.createDataFrame([(d, t, "s") for d, t in ODD], "doc_id long, text string, start string").repartition(3)
    got = [tuple(r) for r in tokens.token_rows(df).orderBy("doc_id").collect()]
    assert got == expected(sorted(ODD, key=lambda r: r[0]))


def test_small_shards_repeated_and_null_ids(spark):
    rows = [(k % 7 if k % 11 else None, f"text {k % 5} of {k % 7}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = tokens.write_shards(df, PATH, shard_ids=100)
    assert shards.count() > 5
    got = sorted(tuple(r) for r in tokens.read_shards(shards).select("start", "n_tokens").collect())
    assert [s for s, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1].tolist()]
    assert tokens.read_shards(shards).where("doc_id is null").count() == sum(d is None for d, _ in rows)


def test_empty(spark):
    assert tokens.token_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert [tuple(r) for r in tokens.op10_token_binary(spark, sf).orderBy("start").collect()] == expected(rows)


def test_remembered_chunks_stay_small():
    """A worker that has seen 900,000 different chunks keeps less than 80 MB of them."""
    enc = tokens.Encoder(PATH)
    enc._code = lambda chunks: enc.known.update((c, c[:4] * 2) for c in chunks)
    for k in range(0, 900_000, 5000):
        enc.ids([" ".join(f"w{i}q" for i in range(k, k + 5000))])
    kept = [enc.known, getattr(enc, "older", {})]
    assert sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in kept) < 80e6


def test_frequent_chunks_are_coded_once(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 400)
    enc, coded, code = tokens.Encoder(PATH), [], None
    code = enc._code
    enc._code = lambda chunks: (coded.extend(chunks), code(chunks))
    texts = [" ".join(["often,", "Seen", *(f"rare{k}x{i}" for i in range(60))]) for k in range(30)]
    got = [enc.ids([t])[0] for t in texts]
    assert got == [x[:-1].tobytes() for x in library(texts)]
    assert [coded.count(c) for c in (b"often", b"seen", b",")] == [1, 1, 1]


def test_marks_take_no_room_from_words(monkeypatch):
    """Words that come back with other marks are remembered once, without them."""
    monkeypatch.setattr(tokens, "CACHE", 400)
    enc, coded = tokens.Encoder(PATH), []
    code = enc._code
    enc._code = lambda chunks: (coded.extend(chunks), code(chunks))
    texts = [" ".join(f"{kind}{k}x{mark}" for k in range(90)) for mark in (",", ".", "", "!") for kind in ("some", "Other")]
    got = [enc.ids([t])[0] for t in texts]
    assert got == [x[:-1].tobytes() for x in library(texts)]
    assert len(coded) == len(set(coded)) == 183


def test_texts_split_together():
    """Texts of one run do not touch each other, and those that can't be split keep their place."""
    texts = ["A", "\u0301b, c.", None, "H", "<|ENDOFTEXT|> it's", "", ".", "x" * 5000, "\u0331 J\u030c. Den", " a,\tb!?\x0bc\x1c,d ", "<|endoftext|>", "-", "e-.", "é, É."]
    ids, sizes = tokens.Encoder(PATH).coded(texts)
    want = [x[:-1] for x in library(texts)]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x.tolist()]


def test_words_of_groups_that_the_library_parts_otherwise():
    """Letters that composition or lower case takes apart spoil their group of words only."""
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    words[40:40] = ["\u0130x", "\uac00\u0301", "x\u0130"]
    got = tokens.Encoder(PATH).ids([w for w in words] + [" ".join(words)])
    assert got == [x[:-1].tobytes() for x in library([w for w in words] + [" ".join(words)])]


def test_runs_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(tokens, "SPLIT_BYTES", 10)
    texts = ["a" * 4, "b" * 6, None, "c" * 30, "", "d" * 3, "é" * 4, "e"]
    runs = [r.column(1).to_pylist() for r in tokens._runs(pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"]))]
    assert runs == [texts[:3], texts[3:4], texts[4:6], texts[6:]]
