"""Token ids in files coded with a static range asymmetric numeral system.

A shard file: magic, length and JSON of the header, then the sections that the header
places: document ids and lengths (zlib), the table of frequencies shared by all blocks
(zlib), the blocks. The header has a checkpoint for each block (place, ids before it in
the shard, lanes, checksum of the coded bytes and of the ids), so that blocks can be
decoded on their own and in parallel.

Defined cases: a null text is empty and gives the end id alone; repeated rows are
written one after the other, ordered by text; a null doc_id comes first; a document
never spans two shards and is never cut; an empty table gives no shard; extra columns
are ignored. Control strings of the tokenizer inside a text become its special ids, as
the library does by default. A shard holds at most 2**19 different ids, far above the
vocabularies of public tokenizers; more of them are an error, never a loss.

The offsets of shards are one running sum over the manifest, which has one row for
each 4 million ids (2.5 million rows for 10**13 ids).
"""

from __future__ import annotations

import io
import json
import os
import re
import string
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import few_rows, held, scratch, table, written
from .files import open_in, open_out

MAGIC = b"TWRANS1\n"
#: Ids after which a shard is closed.
SHARD_IDS = 4_000_000
#: Distinct chunks that a worker remembers, in two generations (about 200 bytes each; an executor has a worker for each core).
CACHE = 300_000
END_ID = 1
#: Rows that a worker gets at a time.
WRITE_ROWS = 1024
#: Blocks that one task decodes at a time when shards are read back.
UNIT_BLOCKS = 4
#: Bytes of text that the encoder splits at a time; a longer text goes alone.
SPLIT_BYTES = 1 << 21
_MARKS = string.punctuation.encode()
_MARK, _ALNUM, _SPACE = (np.isin(np.arange(256), list(x)) for x in (_MARKS, (string.ascii_letters + string.digits).encode(), b" \t\n\r\x0b\x0c"))
#: A capital that a combining mark may follow: the library composes before it lowers the case, and
#: not all capitals compose as their small letters do, so such texts are not put in lower case here.
_COMPOSED = re.compile(rb"[A-Z][\x80-\xff]")


def _ends_in_letter(base: bytes) -> bool:
    """Whether ``base``, once composed and in lower case, ends in a letter or digit for certain.

    Letters beyond ASCII are taken from the Latin blocks only, where all versions of Unicode
    agree, and only if their lower case is one letter: that of U+0130 ends in a combining dot,
    which the splitting pattern keeps with the marks that follow. A base that ends in any
    other character is coded together with its marks."""
    if base[-1:].isalnum():
        return True
    low = base[-2:].decode().lower() if b"\xc3" <= base[-2:-1] <= b"\xc9" else ""
    return len(low) == 1 and low.isalpha()


class Encoder:
    """The library's ids of whole texts, found once for each distinct chunk between ASCII white space.

    Neither normalisation nor the splitting patterns of a tokenizer whose normalizer
    folds white space look across white space, so the ids of a text are those of its
    chunks, one after the other. Tokenizers of other kinds get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        kinds = json.dumps(spec.get("normalizer") or {}) + json.dumps(spec.get("pre_tokenizer") or {})
        self.chunked = '"Lowercase"' in kinds and '"Removed"' in kinds and '"add_prefix_space": false' in kinds
        self.marks = [t["content"].lower().encode() for t in spec.get("added_tokens", [])]
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.chunked = self.chunked and bool(suffix)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _unknown(self, chunks) -> list[bytes]:
        """Those that neither generation has; what the older one has of them comes to the younger."""
        known, older, out = self.known, self.older, []
        for c in chunks:
            if c not in known:
                if (ids := older.get(c)) is None:
                    out.append(c)
                else:
                    known[c] = ids
        return out

    def _found(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks. Only those that the younger generation lacks are put into it, so that a
        full one is followed by one that begins with what is new to it."""
        found = list(map(self.known.get, chunks))
        lack = [k for k, ids in enumerate(found) if ids is None]
        if lack:
            older = {c: ids for k in lack if (ids := self.older.get(c := chunks[k])) is not None}
            if len(self.known) + len(lack) > CACHE // 2:
                self.older, self.known = self.known, {}
            self.known.update(older)
            self._learn([c for k in lack if (c := chunks[k]) not in older])
            for k in lack:
                found[k] = self.known[chunks[k]]
        return found

    def _learn(self, chunks: list[bytes]) -> None:
        """Puts distinct chunks that neither generation has into the younger one.

        A chunk that ends in ASCII marks after a letter or digit has the ids of its two pieces,
        which the splitting pattern parts anyway; so ``word,`` and ``word.`` are coded once."""
        marked, plain, pieces = [], [], set()
        for c in chunks:
            base = c.rstrip(_MARKS)
            if len(base) < len(c) and base and _ends_in_letter(base):
                marked.append((c, base))
                pieces.update((base, c[len(base) :]))
            else:
                plain.append(c)
        known = self.known
        self._code(plain + self._unknown(pieces.difference(plain)))
        for c, base in marked:
            known[c] = known[base] + known[c[len(base) :]]

    def _code(self, chunks: list[bytes]) -> None:
        """Words of letters go to the library joined by spaces: each has one id that ends a
        word. A group that has another number of such ids is coded chunk by chunk."""
        texts = [c.decode() for c in chunks]
        words, single = [], []
        for k, t in enumerate(texts):
            (words if t.isalpha() else single).append(k)
        for a in range(0, len(words), 2048):
            groups = [words[k : k + 32] for k in range(a, min(a + 2048, len(words)), 32)]
            found = self.tok.encode_batch_fast([" ".join([texts[k] for k in g]) for g in groups], add_special_tokens=False)
            found = [e.ids for e in found]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum())
            ends, stop = np.append(False, self.ends[ids]), np.cumsum(sizes)
            good = ends[stop] & (np.diff(np.cumsum(ends)[stop], prepend=0) == np.fromiter(map(len, groups), np.int64, len(groups)))
            for group in (groups[k] for k in np.flatnonzero(~good)):
                single += group
            kept = np.repeat(good, sizes)
            raw, cuts = ids[kept].tobytes(), (4 * np.flatnonzero(ends[1:][kept]) + 4).tolist()
            for k, x, y in zip((k for g, whole in zip(groups, good.tolist()) if whole for k in g), [0, *cuts], cuts):
                self.known[chunks[k]] = raw[x:y]
        for a in range(0, len(single), 2048):
            part = single[a : a + 2048]
            for k, e in zip(part, self.tok.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)):
                self.known[chunks[k]] = np.array(e.ids, np.uint32).tobytes()

    def _split(self, raws: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct chunks, which of them the texts are, one after the other, how many each text has).

        One ASCII mark after an ASCII letter or digit at the end of a chunk is a chunk of its own (see ``_learn``)."""
        sizes = np.array([len(r) + 1 for r in raws])
        joined = b"\n".join([*raws, b""])
        raw, ends = np.frombuffer(joined, np.uint8), np.cumsum(sizes)
        text = np.frombuffer(bytearray(joined.lower()), np.uint8)
        for k in np.unique(np.searchsorted(ends, np.flatnonzero((raw[1:] >= 0x80) & (raw[:-1] - 65 < 26)), "right")):
            text[ends[k] - sizes[k] : ends[k]] = raw[ends[k] - sizes[k] : ends[k]]
        space = _SPACE[text]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        start, stop = edges[::2], edges[1::2]
        marked = _MARK[text[stop - 1]] & _ALNUM[text[stop - 2]] & (stop - start > 1)
        n = 1 + marked
        first = (np.cumsum(n) - n)[marked]
        start, stop = np.repeat(start, n), np.repeat(stop, n)
        stop[first] -= 1
        start[first + 1] = stop[first]
        at = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(text[~space])]).dictionary_encode()
        count = np.diff(np.searchsorted(stop, ends, "right"), prepend=0)
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), count

    def coded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each text has)."""
        raws = [(text or "").encode() for text in texts]
        whole = {}
        low = b"\n".join(raws).lower()
        odd = not self.chunked or any(m in low for m in self.marks)
        for k, raw in enumerate(raws) if odd else ():
            if not self.chunked or any(m in raw.lower() for m in self.marks):
                whole[k] = np.array(self.tok.encode_batch_fast([texts[k] or ""], add_special_tokens=False)[0].ids, np.uint32)
                raws[k] = b""
        chunks, which, count = self._split(raws)
        found = self._found(chunks)
        pool = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = (np.cumsum(size) - size)[which]
        size = size[which]
        stop = np.cumsum(size)
        ids = pool[np.repeat(begin - (stop - size), size) + np.arange(size.sum())]
        ends = np.concatenate(([0], stop))[np.cumsum(count)]
        if whole:
            parts = np.split(ids, ends[:-1])
            parts = [whole.get(k, part) for k, part in enumerate(parts)]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, np.diff(ends, prepend=0)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, sizes = self.coded(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    symbols, freq = rans.table(ids)
    coder = rans.Coder(symbols, freq)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [zlib.compress(np.array([d or 0 for d in doc_ids], np.int64).tobytes() + known.tobytes() + np.array(lengths, np.int64).tobytes()), zlib.compress(symbols.tobytes() + freq.tobytes())]
    points = []
    for a in range(0, len(ids), rans.BLOCK):
        block = ids[a : a + rans.BLOCK]
        lanes, state, words = coder.encode(block)
        raw = state.tobytes() + words.tobytes()
        points.append([len(raw), a, len(block), lanes, zlib.crc32(raw), zlib.crc32(block.tobytes())])
        parts.append(raw)
    head = json.dumps({"docs": [len(doc_ids), len(parts[0])], "table": [len(symbols), len(parts[1])], "ids": len(ids), "blocks": points}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *parts])


class Shard:
    """A shard file, open: header, documents and table are read once, blocks one by one by their place."""

    def __init__(self, f):
        self.f = f
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard")
        at = len(MAGIC) + 8
        size = int.from_bytes(self._at(len(MAGIC), 8), "little")
        self.head, at = json.loads(self._at(at, size)), at + size
        n, size = self.head["docs"]
        docs, at = zlib.decompress(self._at(at, size)), at + size
        known = np.frombuffer(docs, np.uint8, n, 8 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(docs, np.int64, n), known)]
        self.lengths = np.frombuffer(docs, np.int64, n, 9 * n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        m, size = self.head["table"]
        tab, at = zlib.decompress(self._at(at, size)), at + size
        self.coder = rans.Coder(np.frombuffer(tab, np.uint32, m), np.frombuffer(tab, np.uint32, m, 4 * m))
        self.places = at + np.cumsum([0, *[p[0] for p in self.head["blocks"]]])

    def _at(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        return self.f.read(size)

    def block(self, k: int) -> np.ndarray:
        """Ids of block ``k`` alone, from its checkpoint."""
        size, _, n, lanes, crc, ids_crc = self.head["blocks"][k]
        body = self._at(int(self.places[k]), size)
        if zlib.crc32(body) != crc:
            raise ValueError(f"block {k}: checksum of the coded bytes differs")
        ids = self.coder.decode(n, lanes, np.frombuffer(body, np.uint64, lanes), np.frombuffer(body, np.uint32, offset=8 * lanes))
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError(f"block {k}: checksum of the ids differs")
        return ids

    def documents(self, lo: int = 0, hi: int | None = None):
        """(id, start in the shard, ids) of the documents that start in the blocks lo..hi-1.

        Blocks are decoded as they are needed and dropped when no document is left in them;
        the last document may reach into blocks beyond ``hi``."""
        blocks = self.head["blocks"]
        hi = len(blocks) if hi is None else min(hi, len(blocks))
        if lo >= hi:
            return
        first = blocks[lo][1]
        end = blocks[hi][1] if hi < len(blocks) else self.head["ids"]
        ids, base, k = np.zeros(0, np.uint32), first, lo
        for d in range(int(np.searchsorted(self.starts, first)), int(np.searchsorted(self.starts, end))):
            start, stop = int(self.starts[d]), int(self.starts[d] + self.lengths[d])
            if base + len(ids) < stop:
                parts = [ids[start - base :]] if start < base + len(ids) else []
                base = start if parts else base + len(ids)
                while sum(map(len, parts)) + base < stop:
                    parts.append(self.block(k))
                    k += 1
                ids = np.concatenate(parts)
            yield self.doc_ids[d], start, ids[start - base : stop - base]


def read_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a shard file."""
    shard = Shard(io.BytesIO(raw))
    blocks = [shard.block(k) for k in range(len(shard.head["blocks"]))]
    return shard.doc_ids, shard.lengths, np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


_MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def _runs(batch: pa.RecordBatch):
    """Runs of rows with at most ``SPLIT_BYTES`` of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        past = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, past + SPLIT_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _writer(folder: str, tokenizer: str, end_id: int, shard_ids: int):
    def run(batches):
        from pyspark import TaskContext

        enc, part, attempt = encoder(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        end = np.array([end_id], np.uint32)
        docs, lengths, coded, n, seq = [], [], [], 0, 0

        def flush():
            path = f"{folder}/shard-{part:06d}-{seq:05d}-{attempt}.rans"
            raw = shard_bytes(docs, lengths, np.concatenate(coded))
            with open_out(path) as f:
                f.write(raw)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, seq, path, len(docs), n, len(raw)), _MANIFEST.types)], schema=_MANIFEST)

        for batch in batches:
            for some in _runs(batch):
                ids, sizes = enc.coded(some.column(1).to_pylist())
                at = 0
                for doc, size in zip(some.column(0).to_pylist(), sizes.tolist()):
                    if n and n + size + 1 > shard_ids:
                        yield flush()
                        docs, lengths, coded, n, seq = [], [], [], 0, seq + 1
                    docs.append(doc)
                    lengths.append(size + 1)
                    coded += (ids[at : at + size], end)
                    at += size
                    n += size + 1
        if n:
            yield flush()

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the ids of ``docs`` in ascending doc_id order; returns the table of shards.

    One shuffle: rows are dealt out by ranges of (doc_id, hash of the text), so repeated
    ids do not meet in one task, and sorted on disk if need be. ``first`` is the number
    of ids in all shards before.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), key).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key)
    shards = rows.mapInArrow(_writer(folder, tokenizer, end_id, shard_ids), "part long, seq long, path string, n_docs long, n_ids long, n_bytes long")
    with few_rows(spark, WRITE_ROWS):
        shards = written(shards, "manifest")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("first", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _reader(batches):
    for batch in batches:
        for path, first, lo in zip(*(c.to_pylist() for c in batch.columns)):
            rows = []
            with open_in(path) as f:
                for doc, start, ids in Shard(f).documents(lo, lo + UNIT_BLOCKS):
                    rows.append((doc, first + start, len(ids), zlib.crc32(ids)))
                    if len(rows) == 65536:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_READ)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_READ)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    Runs of ``UNIT_BLOCKS`` blocks are dealt to the tasks, each decoded from its checkpoint;
    a document belongs to the run in which it starts."""
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.floor((F.col("n_ids") - 1) / F.lit(rans.BLOCK))
    units = shards.select("path", "first", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(UNIT_BLOCKS).cast("long"))).alias("lo"))
    return units.repartition(n, "path", "lo").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_rows(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_shards(write_shards(docs, str(tokenizer)))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))
