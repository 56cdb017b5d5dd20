"""Exact Jaccard join of word n-gram sets by size-aware heavy-light processing.

1. Each text becomes its set of distinct shingles of ``width`` words (64-bit hashes).
   Shingles are counted once over the whole corpus: batches of documents send their
   distinct keys with the number of their documents that have each, dealt by ranges of
   the key, and get back a class of the sums; who has which key waits in a file of the
   shared folder. A shingle that all documents have is one number for each batch. A set of
   n shingles of which more than n - ceil(t * n) are nobody else's can have no partner and is done.
2. Equal sets are one set from here on, under their smallest document id.
3. Light sets (at most ``boundary`` shingles): each pair of sizes (n, m) needs a fixed
   overlap c, so every set enumerates its subsets of c shared shingles; sets that have a
   subset in common are linked, and a star by subset links them without any pair.
4. Heavy sets: by prefix filter (rarest shingles first) sets that can be partners share a
   rare shingle; stars over these inverted lists give groups that hold every possible
   pair. A group of bounded weight is one task, which scans the group's inverted lists to
   count exact overlaps. A heavier one is cut into cells by size class and by what its
   stars have linked already, and pairs of cells are tasks. Tasks return spanning edges only,
   never all pairs.
5. Connected components of the edges.

The boundary is chosen by cost: subsets to be enumerated against inverted-list entries,
from a histogram of small sizes.

Parts grow with the text (``PART_KEYS`` keys in each), so a task's memory does not. With
more than some hundred thousand parts a block holds a few keys only, and the exchange costs
what a plain shuffle of keys would. Links are exact up to collisions of 64-bit hashes.

Defined cases: null, empty and wordless texts have no shingles, link with nothing and are
their own component; a text of fewer than ``width`` words is one shingle; repeated rows
are each a row of the result; a null doc_id links with nothing; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, few_rows, release, scratch, table, union_find, written
from .files import open_in, open_out

#: Near duplicates: shingles of five words, Jaccard of 80 % or more. The query ``op2`` has its own.
WIDTH, PERCENT = 5, 80
#: Documents and shingles of one batch; a batch's memory and its local document numbers.
BATCH_DOCS, BATCH_SHINGLES = 32768, 1_500_000
#: Largest boundary considered, and the cost of an inverted-list entry in subsets.
MAX_LIGHT, LIST_COST = 24, 16
#: Weight (shared shingles) of a group or cell of heavy sets that is compared in one task.
BLOCK_WEIGHT = 1 << 17
#: Candidates of one star that are checked in one task, and keys of a part that are counted together.
STAR, PART_KEYS = 4096, 1 << 21
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _A = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * _A + w[j : len(w) - k + 1 + j])
    return np.unique(h)


_BLOCK = pa.schema([("b", pa.int64()), ("r", pa.int32()), ("file", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_BLOCK_SQL = "b long, r int, file string, place long, size long, keys binary, counts binary"
_DOC = np.dtype([("known", "u1"), ("id", "<i8"), ("n", "<i8"), ("f1", "<u8"), ("f2", "<u8")])


def _planes(keys: np.ndarray) -> bytes:
    """Byte planes of 64-bit keys; sorted keys make the upper planes compress."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, ::-1].T).tobytes()


def _keys(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1)[::-1].T).view("<u8").ravel()


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: equal ranges of the upper half, so parts of sorted keys are in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _send(parts: int, width: int, folder: str, most_docs: int):
    """Documents to blocks of distinct shingle keys and how many documents of the batch have each, one for
    each batch and part. Who has them stays in a file until the counts come back."""

    def run(batches):
        from pyspark import TaskContext

        release()
        task = TaskContext.get().partitionId()
        file = f"{folder}/batches-{task:06d}-{uuid.uuid4().hex[:12]}"
        out, place, seq, docs, sets, held = None, 0, 0, [], [], 0

        def flush():
            nonlocal out, place, seq, docs, sets, held
            info = np.array(docs, _DOC)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            order = np.argsort(flat)
            flat, at = flat[order], np.repeat(np.arange(len(info), dtype=np.uint16), info["n"])[order]
            begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate((begin, [len(flat)]))).astype("<u2")
            keys = flat[begin]
            raw = [info.tobytes(), zlib.compress(count.tobytes(), 1), at.astype("<u2").tobytes()]
            raw = np.array([len(x) for x in raw], "<i8").tobytes() + b"".join(raw)
            out = out or open_out(file)
            out.write(raw)
            part = _part(keys, parts)
            used = np.unique(np.concatenate(([0], part.astype(np.int64))))  # part 0 always, as it carries the place
            lo, hi = np.searchsorted(part, used), np.searchsorted(part, used, side="right")
            name = (task << 32) + seq
            rows = [(name, int(r), file if r == 0 else None, place if r == 0 else len(used), len(raw) if r == 0 else None, _planes(keys[x:y]), count[x:y].tobytes()) for r, x, y in zip(used, lo, hi)]
            place, seq, docs, sets, held = place + len(raw), seq + 1, [], [], 0
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64]), _BLOCK.types)], schema=_BLOCK)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                u = shingles(text.as_py(), width)
                docs.append((doc is not None, doc or 0, len(u), int(u.sum(dtype=np.uint64)), int(_mix(u + _A).sum(dtype=np.uint64))))
                sets.append(u)
                held += len(u)
                if held >= BATCH_SHINGLES or len(docs) >= most_docs:
                    yield from flush()
        if docs:
            yield from flush()
        if out is not None:
            out.close()

    return run


_SHARED = pa.schema([("b", pa.int64()), ("r", pa.int32()), ("file", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("levels", pa.binary()), ("keys", pa.binary())])
_SHARED_SQL = "b long, r int, file string, place long, size long, levels binary, keys binary"


def _by(column: int, batches):
    """Rows of consecutive equal values of a column, as lists."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[column] != now:
                yield now, rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield now, rows


def _count(batches):
    """Per part: sums of the batches' counts. Back to each batch go a class of the sum for each of its
    keys (0: one document alone has it) and the keys that are not alone."""
    for _, rows in _by(1, batches):
        keys = [_keys(x[5]) for x in rows]
        flat, count = np.concatenate(keys), np.concatenate([np.frombuffer(x[6], "<u2") for x in rows])
        level = np.zeros(len(flat), np.uint8)
        if len(flat):
            order = np.argsort(flat, kind="stable")  # of sorted runs
            same = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
            total = np.add.reduceat(count[order].astype(np.int64), np.flatnonzero(same))
            level[order] = np.minimum(255, np.floor(8 * np.log2(total))).astype(np.uint8)[np.cumsum(same) - 1]
        at = 0
        for (b, r, file, place, size, _, _), k in zip(rows, keys):
            own = level[at : at + len(k)]
            at += len(k)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((b, r, file, place, size, own.tobytes(), k[own > 0].tobytes()), _SHARED.types)], schema=_SHARED)


def least(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


_SET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("shared", pa.binary())])
_SET_SQL = "doc_id long, n long, f1 long, f2 long, shared binary"


def _gather(percent: int):
    """Per batch: its documents, with their shared shingles, rarest first, if they can have a partner."""

    def run(batches):
        for b, rows in _by(0, batches):
            _, r, file, place, size, _, _ = rows[0]
            if r != 0 or any(x[3] != len(rows) for x in rows[1:]):
                raise ValueError(f"batch {b}: parts are missing")
            with open_in(file) as f:
                raw = f.read_at(size, place)
            cut = 24 + np.cumsum([0, *np.frombuffer(raw, "<i8", 3)])
            info, count, at = np.frombuffer(raw[cut[0] : cut[1]], _DOC), np.frombuffer(zlib.decompress(raw[cut[1] : cut[2]]), "<u2"), np.frombuffer(raw[cut[2] :], "<u2")
            level = np.concatenate([np.frombuffer(x[5], np.uint8) for x in rows])
            key = np.concatenate([np.frombuffer(x[6], "<u8") for x in rows])
            if len(level) != len(count):
                raise ValueError(f"batch {b}: counts do not fit its keys")
            some = level > 0
            at = at[np.repeat(some, count)]
            key, level = np.repeat(key, count[some]), np.repeat(level[some], count[some])
            order = np.lexsort((key, level, at))
            key, cut = key[order], np.searchsorted(at[order], np.arange(len(info) + 1))
            shared = []
            for k, n in enumerate(info["n"].tolist()):
                own = key[cut[k] : cut[k + 1]]
                alone = n - len(own)
                shared.append(own.tobytes() if len(own) and alone <= n - least(n, percent) else None)
            ids = pa.array(info["id"], pa.int64(), mask=info["known"] == 0)
            cols = [ids, pa.array(info["n"]), pa.array(info["f1"].view(np.int64)), pa.array(info["f2"].view(np.int64)), pa.array(shared, pa.binary())]
            for a in range(0, len(info), 2048):
                yield pa.RecordBatch.from_arrays([c.slice(a, 2048) for c in cols], schema=_SET)

    return run


def shared_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, part_keys: int = PART_KEYS, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """doc_id, n, fingerprint (f1, f2) and ``shared`` (null: no partner is possible)."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # shingles are at most the words; parts grow with them, so that the keys of one fit in a task
    length = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(tasks, min(1 << 30, -(-int(length) // (6 * part_keys))))
    sent = rows.mapInArrow(_send(parts, width, scratch(spark, "batches"), batch_docs), _BLOCK_SQL)
    # blocks of few parts are large rows: few of them at a time go to a worker
    with few_rows(spark, min(10_000, 3 * parts)):
        counted = sent.repartition(tasks, "r").sortWithinPartitions("r", "b").mapInArrow(_count, _SHARED_SQL)
        back = counted.repartition(tasks, "b").sortWithinPartitions("b", "r").mapInArrow(_gather(percent), _SET_SQL)
        return written(back, "sets")


def overlap(n: int, m: int, percent: int) -> int:
    """Least overlap at which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, upto: int, percent: int) -> list[int]:
    return [m for m in range(least(n, percent), min(upto, 100 * n // percent) + 1) if overlap(n, m, percent) <= min(n, m)]


def choose_boundary(histogram: list[tuple[int, int, int]], percent: int = PERCENT, list_cost: float = LIST_COST) -> int:
    """The boundary of least cost; ``histogram``: (n, shared shingles, number of sets)."""

    def cost(b: int) -> float:
        total = 0.0
        for n, s, count in histogram:
            if n <= b:
                total += count * sum(math.comb(s, overlap(n, m, percent)) for m in partners(n, b, percent))
            if 100 * n >= percent * (b + 1):
                total += count * list_cost * max(0, n - least(n, percent) + 1 - (n - s))
        return total

    return min(range(MAX_LIGHT + 1), key=lambda b: (cost(b), b))


def _subsets(boundary: int, percent: int):
    from xxhash import xxh64_intdigest

    schema = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("n", pa.int32()), ("doc", pa.int64())])

    def run(batches):
        for batch in batches:
            for doc, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = [raw[k : k + 8] for k in range(0, len(raw), 8)]
                keys, lo, hi = [], [], []
                for m in partners(n, boundary, percent):
                    for c in combinations(own, overlap(n, m, percent)):
                        keys.append(xxh64_intdigest(b"".join(c), seed=min(n, m) * 64 + max(n, m)) - (1 << 63))
                        lo.append(min(n, m))
                        hi.append(max(n, m))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array([n] * len(keys), pa.int32()), pa.array([doc] * len(keys), pa.int64())], schema=schema)

    return run


def _prefixes(percent: int):
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64())])

    def run(batches):
        for batch in batches:
            keys, docs = [], []
            for doc, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = np.frombuffer(raw, "<i8")
                own = own[: n - least(n, percent) + 1 - (n - len(own))]
                keys.append(own)
                docs.append(np.full(len(own), doc, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(docs))], schema=schema)

    return run


def links(rows: list[tuple[int, int, int, bytes]], cross: bool, percent: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among sets (side, doc, n, shared); ``cross``: between the sides only.

    Scans, for each set, the inverted lists of its shingles and counts overlaps. Sets are
    sorted by side, so those after a set (or on the other side) are one range of numbers.
    """
    rows = sorted(rows, key=lambda x: x[0])
    sets = [np.frombuffer(x[3], "<u8") for x in rows]
    size = np.array([x[2] for x in rows])
    length = np.array([len(s) for s in sets])
    first_right = sum(x[0] == 0 for x in rows)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(rows)), length)
    order = np.argsort(flat, kind="stable")
    lists = owner[order]
    uniq, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    begin = np.concatenate(([0], np.cumsum(length)))
    pairs = []
    for x in range(first_right if cross else len(rows) - 1):
        t = inverse[begin[x] : begin[x + 1]]
        t = t[count[t] > 1]
        if not len(t):
            continue
        c = count[t]
        place = np.repeat(start[t] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
        o = np.bincount(lists[place], minlength=len(rows))
        lo = first_right if cross else x + 1
        y = lo + np.flatnonzero(100 * o[lo:] >= percent * (size[x] + size[lo:] - o[lo:]))
        pairs += [(x, int(k)) for k in y]
        if len(pairs) > 1 << 20:
            pairs = union_find(len(rows), pairs)
    return [(rows[a][1], rows[b][1]) for a, b in union_find(len(rows), pairs)]


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        a, b = [], []
        for _, rows in _by(0, batches):
            found = links([x[2:] for x in rows], rows[0][1], percent)
            a += [x for x, _ in found]
            b += [x for _, x in found]
            if len(a) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _light(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Edges among sets of at most ``boundary`` shingles: stars over common subsets."""
    small = sets.where(F.col("n") <= boundary).select("doc_id", "n", "shared")
    keys = written(small.mapInArrow(_subsets(boundary, percent), "key long, lo int, hi int, n int, doc long"), "subsets")
    stars = keys.groupBy("key", "lo", "hi").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    stars = stars.where("a < z and (lo = hi or n0 < n1)").select("key", "lo", "hi", "a")
    return keys.join(stars, ["key", "lo", "hi"]).where("a < doc").select("a", F.col("doc").alias("b")).distinct()


def _units(sides: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges from ``sides(unit, cross, side, doc_id)``: each unit with its sets in one task."""
    dealt = sides.join(sets, "doc_id").select("unit", "cross", "side", F.col("doc_id").alias("doc"), "n", "shared")
    return dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verify(percent), "a long, b long")


def _large(groups: DataFrame, edges: DataFrame, sets: DataFrame, percent: int, weight: int) -> DataFrame:
    """Edges inside groups that are too heavy for one unit.

    First the candidate stars themselves are checked, which is linear, and what they link is a class.
    Then sets go to cells by size class (partners are in the same or the next one) and, inside it, to
    cells of one heavy class each or of several light ones by hash. Pairs of cells of one group and near
    size classes are compared, but not cells of one and the same class: those are linked already."""
    stars = edges.join(groups.select(F.col("doc_id").alias("b"), "comp"), "b").select("a", "b")
    hubs = stars.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("splits"))
    stars = stars.join(hubs, "a").withColumn("unit", F.concat_ws("-", F.lit("s"), "a", F.pmod(F.xxhash64("b"), F.col("splits"))))
    heads = stars.select("unit", F.lit(True).alias("cross"), F.lit(0).alias("side"), F.col("a").alias("doc_id")).distinct()
    linked = written(_units(heads.unionByName(stars.select("unit", F.lit(True).alias("cross"), F.lit(1).alias("side"), F.col("b").alias("doc_id"))), sets, percent), "star-links")
    classes = components(linked).select(F.col("id").alias("doc_id"), F.col("comp").alias("known"))
    # n <= m <= n * 100 / percent puts m into the size class of n or the next
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + F.lit(1e-9))
    rows = written(groups.join(classes, "doc_id", "left").select("doc_id", "comp", "n", "w", F.coalesce("known", "doc_id").alias("known"), size.alias("size")), "group-rows")
    split = lambda: F.ceil(F.col("w") / F.lit(weight)).cast("int")
    per = rows.groupBy("comp", "size", "known").agg(F.sum("w").alias("w"))
    heavy = per.where(F.col("w") > weight).select("comp", "size", "known", split().alias("splits"))
    light = per.where(F.col("w") <= weight).groupBy("comp", "size").agg(F.sum("w").alias("w")).select("comp", "size", split().alias("shared_splits"))
    placed = rows.join(heavy, ["comp", "size", "known"], "left").join(light, ["comp", "size"], "left")
    alone = F.col("splits").isNotNull()
    cell = F.when(alone, F.concat_ws(".", "size", "known", F.pmod(F.xxhash64("doc_id"), F.col("splits")))).otherwise(F.concat_ws(".", "size", F.lit("all"), F.pmod(F.xxhash64("known"), F.col("shared_splits"))))
    placed = written(placed.select("doc_id", "comp", "size", cell.alias("cell"), F.when(alone, F.col("known")).alias("solo")), "cells")
    cells = placed.groupBy("comp", "size", "cell", "solo").agg(F.count("*").alias("c"))
    left = cells.select("comp", F.explode(F.array("size", F.col("size") + 1)).alias("size"), F.col("size").alias("own"), F.col("cell").alias("i"), F.col("solo").alias("solo_i"), "c")
    right = cells.select("comp", "size", F.col("cell").alias("j"), F.col("solo").alias("solo_j"))
    pairs = left.join(right, ["comp", "size"]).where("(size > own or i <= j) and coalesce(solo_i <> solo_j, true) and (i <> j or c > 1)")
    pairs = pairs.select("comp", "i", "j", (F.col("i") != F.col("j")).alias("cross"), F.concat_ws("-", "comp", "i", "j").alias("unit"))
    sides = pairs.select("comp", F.col("i").alias("cell"), "unit", "cross", F.lit(0).alias("side")).unionByName(pairs.where("cross").select("comp", F.col("j").alias("cell"), "unit", "cross", F.lit(1).alias("side")))
    found = _units(placed.select("doc_id", "comp", "cell").join(sides, ["comp", "cell"]).select("unit", "cross", "side", "doc_id"), sets, percent)
    return linked.unionByName(found)


def _heavy(sets: DataFrame, boundary: int, percent: int, weight: int) -> DataFrame:
    """Edges among sets that may have a partner above ``boundary``."""
    big = sets.where(F.col("n") * 100 >= percent * (boundary + 1)).select("doc_id", "n", "shared")
    lists = written(big.mapInArrow(_prefixes(percent), "key long, doc long"), "lists")
    stars = lists.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("key", "a")
    edges = written(lists.join(stars, "key").where("a < doc").select("a", F.col("doc").alias("b")).distinct(), "candidates")
    groups = components(edges).withColumnRenamed("id", "doc_id")
    slim = big.select("doc_id", "n", F.greatest(F.octet_length("shared") / 8, F.lit(64)).alias("w")).join(groups, "doc_id")
    slim = written(slim, "groups")
    sums = written(slim.groupBy("comp").agg((F.sum("w") > weight).alias("large")), "group-sums")
    light = slim.join(sums.where("not large").select("comp"), "comp")
    found = _units(light.select(F.concat_ws("-", F.lit("g"), "comp").alias("unit"), F.lit(False).alias("cross"), F.lit(0).alias("side"), "doc_id"), big, percent)
    if sums.where("large").count() == 0:
        return found
    large = written(slim.join(sums.where("large").select("comp"), "comp"), "large")
    return found.unionByName(_large(large, edges, big, percent, weight))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, weight: int = BLOCK_WEIGHT, boundary: int | None = None, **exchange: int) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    sets = shared_sets(docs, width, percent, **exchange)
    found = sets.where("shared is not null and doc_id is not null")
    classes = written(found.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("first")), "classes")
    one = written(found.join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "f1", "f2"]), "one-of-each")
    if boundary is None:
        counts = one.where(F.col("n") <= 100 * MAX_LIGHT // percent).groupBy("n", (F.octet_length("shared") / 8).cast("int").alias("s")).count().collect()
        boundary = choose_boundary([tuple(r) for r in counts], percent)
    edges = _light(one, boundary, percent).unionByName(_heavy(one, boundary, percent, weight))
    joined = components(edges)
    classes = classes.join(joined.withColumnRenamed("id", "first"), "first", "left").select("n", "f1", "f2", F.coalesce("comp", "first").alias("component"))
    rows = sets.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
