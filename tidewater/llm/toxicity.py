"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of the hashed character n-grams of ``<word>``; its vector is the mean
of their embeddings, a window's vector the mean over its words, and a softmax over two
classes scores the window. Embeddings and softmax are trained jointly in numpy, so an
unseen misspelling shares most of its n-gram vectors with the word it comes from; training
misspells a share of the words at random, so that no single n-gram carries a word. A
document's score is that of its worst window, so a long document cannot hide a passage.

As the softmax is linear, a trained model needs one number for each n-gram bucket (its
embedding times the difference of the class weights); that table of fixed size is what
is broadcast. Scoring reads each text once and shuffles nothing.

Defined cases: null and wordless texts have no evidence and get 0; repeated rows score alike;
labels that are null are not used; a document with several labels counts as toxic if one
says so; without both classes among the labels every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import string
import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, held, table, with_text

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 12, 6
#: Labelled documents that training reads at most, in the order of a hash of their id.
MAX_TOXIC, MAX_CLEAN = 1500, 4000
#: Words of labelled documents after which training reads no further one (four bytes each on the driver).
MAX_WORDS = 24_000_000
#: Words whose scores a worker remembers before it starts anew.
CACHE = 200_000
#: Words seen in fewer labelled documents teach nothing but that document's label.
MIN_DOCS = 3
_TRIM = string.punctuation.encode()
_LETTERS = string.ascii_lowercase + string.digits + "*@$!"
#: Misspellings of each known word that training mixes in, and the share of words it misspells.
VARIANTS, NOISE = 3, 0.15
_MUL = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every n-gram of ``<word>`` and of the whole word."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))
    buckets, owners = [], []
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(raw) - n + 1] * np.uint64(0x100000001B3) + raw[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            ok = left[: len(h)] >= n
            buckets.append(((h[ok] * _MUL) >> np.uint64(64 - 18)).astype(np.int32))
            owners.append(owner[: len(h)][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, in the order of the words; how many each word has)."""
    flats, sizes = [], []
    for k in range(0, len(words), 20000):
        part = words[k : k + 20000]
        bucket, owner = grams(part)
        flats.append(bucket[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(flats), np.concatenate(sizes)


def split(text: str | None) -> list[bytes]:
    """Lower-case words; a word repeated at once counts once, so that a run of one word is not a window."""
    return [w for w, _ in groupby((text or "").lower().encode().split())]


def misspelt(word: bytes, rng: np.random.Generator) -> bytes:
    """``word`` with one character doubled, dropped, swapped with the next, or replaced."""
    text = word.decode()
    if len(text) < 4:
        return word
    k, kind = int(rng.integers(1, len(text) - 1)), int(rng.integers(4))
    if kind == 0:
        text = text[:k] + text[k] + text[k:]
    elif kind == 1:
        text = text[:k] + text[k + 1 :]
    elif kind == 2:
        text = text[:k] + text[k + 1] + text[k] + text[k + 2 :]
    else:
        text = text[:k] + _LETTERS[int(rng.integers(len(_LETTERS)))] + text[k + 1 :]
    return text.encode()


def _starts(n: int) -> np.ndarray:
    """Where the windows of ``n`` words begin."""
    return np.arange(0, max(1, n - WINDOW + STRIDE) if n else 0, STRIDE)


def train(texts, labels, **options) -> tuple[np.ndarray, float]:
    return train_rows(zip(texts, labels), **options)


def train_rows(rows, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """(one number for each bucket, bias) from (text, label) rows, read once and not kept, until they have ``MAX_WORDS`` words.

    Each epoch fits the worst window of each document (first epoch: all windows), so that only a
    window that has the evidence learns it. The model is the mean over the second half of the epochs."""
    rng = np.random.default_rng(seed)
    known: dict[bytes, int] = {}
    docs, y_doc = [], []
    total = 0
    for text, label in rows:
        docs.append(np.array([known.setdefault(w.strip(_TRIM), len(known)) for w in split(text)], np.int32))
        y_doc.append(label)
        total += len(docs[-1])
        if total >= MAX_WORDS:
            break
    seen = np.bincount(np.concatenate([np.unique(d) for d in docs] or [np.zeros(0, np.int32)]), minlength=len(known))
    used = np.flatnonzero(seen >= MIN_DOCS)
    place = np.full(len(known), -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    docs = [p[p >= 0] for p in (place[d] for d in docs)]
    y_doc = np.array(y_doc, np.float64)
    if not any(map(len, docs)) or y_doc.min() == y_doc.max():
        return np.zeros(BUCKETS, np.float32), -30.0
    words = list(known)
    names = [words[k] for k in used]
    variants = len(names) + np.arange(len(names) * VARIANTS, dtype=np.int32).reshape(-1, VARIANTS)
    names += [misspelt(words[k], rng) for k in used for _ in range(VARIANTS)]
    del words, known
    flat, size = bags(names)
    at = np.concatenate(([0], np.cumsum(size)))
    some = size > 0
    begins = [_starts(len(d)) for d in docs]
    of = np.repeat(np.arange(len(docs)), [len(x) for x in begins])
    length = np.array([len(d) for d in docs])
    lo = np.concatenate(begins)
    ln = np.minimum(lo + WINDOW, length[of]) - lo
    lo = lo + np.concatenate(([0], np.cumsum(length)))[of]
    words = np.concatenate(docs)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    weight = np.where(y_doc > 0, 0.5 / y_doc.mean(), 0.5 / (1 - y_doc.mean()))
    mean, mean_bias, taken = np.zeros(BUCKETS, np.float32), 0.0, 0
    for epoch in range(epochs):
        if epoch == 0:
            pick = rng.permutation(len(of))
        else:
            logit = _window_logits(emb @ (soft[1] - soft[0]), flat, at, some, size, words, lo, ln)
            best = np.lexsort((-logit, of))
            pick = best[np.concatenate(([True], of[best][1:] != of[best][:-1]))]
            rng.shuffle(pick)
        for k in range(0, len(pick), 64):
            p = pick[k : k + 64]
            idx = np.concatenate([np.arange(a, a + n) for a, n in zip(lo[p], ln[p])])
            w = words[idx]
            w = np.where(rng.random(len(w)) < NOISE, variants[w, rng.integers(VARIANTS, size=len(w))], w)
            win = np.repeat(np.arange(len(p)), ln[p])
            g = np.concatenate([flat[at[x] : at[x + 1]] for x in w])
            per = np.repeat(np.arange(len(w)), size[w])
            share = (1.0 / np.maximum(size[w], 1))[per] * (1.0 / ln[p])[win[per]]
            vec = np.zeros((len(p), DIM), np.float32)
            own = win[per]
            for d in range(DIM):
                vec[:, d] = np.bincount(own, emb[g, d] * share, len(p))
            z = vec @ soft.T + bias
            prob = np.exp(z - z.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            y = y_doc[of[p]].astype(int)
            err = prob.copy()
            err[np.arange(len(p)), y] -= 1
            err *= weight[of[p]][:, None]
            d_soft, d_bias, d_vec = err.T @ vec / len(p), err.mean(0), err @ soft
            uniq, inv = np.unique(g, return_inverse=True)
            d_emb = np.stack([np.bincount(inv, d_vec[own, d] * share, len(uniq)) for d in range(DIM)], 1).astype(np.float32)
            g_emb[uniq] += (d_emb**2).mean(1)
            emb[uniq] -= rate * d_emb / np.sqrt(g_emb[uniq])[:, None]
            g_soft += d_soft**2
            soft -= 0.1 * d_soft / np.sqrt(g_soft)
            g_bias += d_bias**2
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
        if 2 * epoch >= epochs:
            mean += emb @ (soft[1] - soft[0])
            mean_bias, taken = mean_bias + float(bias[1] - bias[0]), taken + 1
    if not taken:
        return emb @ (soft[1] - soft[0]), float(bias[1] - bias[0])
    return mean / taken, mean_bias / taken


def _window_logits(table_, flat, at, some, size, words, lo, ln):
    s = np.zeros(len(size), np.float64)
    s[some] = np.add.reduceat(table_[flat].astype(np.float64), at[:-1][some]) / size[some]
    c = np.concatenate(([0.0], np.cumsum(s[words])))
    return (c[lo + ln] - c[lo]) / ln


class Scorer:
    def __init__(self, table_: np.ndarray, bias: float):
        self.table, self.bias, self.known = table_, bias, {}

    def _learn(self, chunks: list[bytes]) -> None:
        for k in range(0, len(chunks), 20000):
            part = chunks[k : k + 20000]
            bucket, owner = grams([c.strip(_TRIM) for c in part])
            size = np.bincount(owner, minlength=len(part))
            s = np.bincount(owner, self.table[bucket], len(part)) / np.maximum(size, 1)
            self.known.update(zip(part, s.tolist()))

    def scores(self, texts: list[str | None]) -> list[float]:
        docs = [split(t) for t in texts]
        new = set().union(*docs).difference(self.known) if docs else set()
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*docs)
        self._learn(list(new))
        get, out = self.known.__getitem__, []
        for d in docs:
            worst = -np.inf
            if d:
                c = np.concatenate(([0.0], np.cumsum(np.fromiter(map(get, d), np.float64, len(d)))))
                a = _starts(len(d))
                b = np.minimum(a + WINDOW, len(d))
                worst = ((c[b] - c[a]) / (b - a)).max()
            out.append(float(1 / (1 + np.exp(-np.clip(worst + self.bias, -60, 60)))) if d else 0.0)
        return out


def _scoring(key: str, model, name: str = "score__", text: int = 0, first: int = 1):
    """The columns from ``first`` on and the score of the text, which is the column ``text``."""

    def run(batches):
        scorer = held(("scorer", key), lambda: Scorer(*model.value))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                scores = scorer.scores(some.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[first:], pa.array(scores, pa.float64())], names=[*some.schema.names[first:], name])

    return run


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[np.ndarray, float]:
    """Trains on at most ``max_toxic`` + ``max_clean`` labelled documents outside the held-out fifth.

    The ids are chosen among the labels alone, by hash order; only then are texts read,
    by a join with that bounded list.
    """
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    own = own.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    picked = own.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(own.where("toxic = 0").orderBy(*order).limit(max_clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "id").orderBy(F.xxhash64("id"), "id", "text")
    return train_rows((r.text, r.toxic) for r in rows.toLocalIterator())


def clean(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, schema, text = with_text(docs)
    scoring, columns = _scoring(uuid.uuid4().hex, shared, text=text, first=0), list(range(len(schema)))

    def run(batches):
        for batch in scoring(batches):
            yield batch.filter(pc.less(batch.column(batch.num_columns - 1), threshold)).select(columns)

    return rows.mapInArrow(run, schema).toDF(*docs.columns)


def score_ids(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of each row of ``docs``; the text does not come back from the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_scoring(uuid.uuid4().hex, shared, "score"), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_ids(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
