"""Near-duplicate vectors by an epsilon grid order join.

Cosine of at least ``t`` is a distance of at most sqrt(2 - 2t) between unit vectors.
Vectors are rotated to their principal axes (from the covariance over all rows, summed in
tasks), sorted by the cells of an epsilon grid on the leading axes, and cut into sequence
intervals. The join recurses over pairs of intervals and skips those whose bounding boxes
are further apart than epsilon; inside a task it goes on with blocks of the two intervals.
What is left is compared by matrix products, and whatever comes near the threshold again
in double precision.

Equal vectors are one vector with a multiplicity, so thousands of copies cost nothing.
Tasks return link counts per vector and spanning edges, never all pairs. The driver holds
the hulls of at most about ``CHUNKS`` runs of intervals and the pairs of those; all further pairs are
found, kept and joined in tasks. Vectors without structure on the leading axes can't be pruned:
then all pairs of intervals are compared, as by any method that is exact, and the intervals
are sent once for each ``TILE`` intervals of the other side.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components,
and rows without a vec_id, link with nothing; vectors of different lengths do not link;
repeated rows are vectors each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, few_rows, table, union_find, written

THRESHOLD = 0.95
#: Axes of the grid and of the boxes, vectors of an interval and of a block inside it.
GRID_AXES, BOX_AXES = 4, 12
INTERVAL, BLOCK = 1024, 256
#: Intervals of a side of a tile of the join, and hulls that the driver begins the recursion with.
TILE, CHUNKS = 16, 512

_VEC = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("vec", pa.binary())])
_VEC_SQL = "vec_id long, dim int, h1 long, h2 long, vec binary"


def _valid(batches):
    """Rows with doubles as bytes and their hashes; null bytes where nothing can link."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        rows = []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.array(v, np.float64) if v and None not in v else None
            if i is None or x is None or not np.isfinite(x).all() or not x.any():
                rows.append((i, None, None, None, None))
            else:
                raw = (x + 0.0).tobytes()  # -0.0 is 0.0
                rows.append((i, len(x), xxh64_intdigest(raw) - (1 << 63), xxh64_intdigest(raw, seed=1) - (1 << 63), raw))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _VEC.types)], schema=_VEC)


def _units(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_SUM = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.binary()), ("outer", pa.binary())])
_SUM_SQL = "dim int, n long, total binary, outer binary"


def _emit(sums):
    for d, (n, total, outer) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((d, n, total.tobytes(), outer.tobytes()), _SUM.types)], schema=_SUM)


def _moments(batches):
    sums: dict[int, list] = {}
    for batch in batches:
        dims, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for d in set(dims):
            u = _units([r for k, r in zip(dims, raws) if k == d])
            s = sums.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
            s[0] += len(u)
            s[1] += u.sum(0)
            s[2] += u.T @ u
    yield from _emit(sums)


def _added(batches):
    sums: dict[int, list] = {}
    for batch in batches:
        for d, n, total, outer in zip(*(c.to_pylist() for c in batch.columns)):
            s = sums.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
            s[0] += n
            s[1] += np.frombuffer(total)
            s[2] += np.frombuffer(outer).reshape(d, d)
    yield from _emit(sums)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per length of vector, the principal axes in order of variance, as columns."""
    found = vectors.select("dim", "vec").mapInArrow(_moments, _SUM_SQL).repartition(8).mapInArrow(_added, _SUM_SQL).collect()
    sums: dict[int, list] = {}
    for d, n, total, outer in found:
        s = sums.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
        s[0] += n
        s[1] += np.frombuffer(total)
        s[2] += np.frombuffer(outer).reshape(d, d)
    return {d: np.linalg.eigh(o / n - np.outer(t / n, t / n))[1][:, ::-1][:, :BOX_AXES].copy() for d, (n, t, o) in sums.items()}


def _cells(shared, eps: float):
    schema = pa.schema([("rep", pa.int64()), ("mult", pa.int64()), ("dim", pa.int32()), ("cell", pa.list_(pa.int32())), ("vec", pa.binary())])

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column(2).to_pylist())
            cells = [None] * len(dims)
            for d in set(dims.tolist()):
                at = np.flatnonzero(dims == d)
                y = _units([batch.column(3)[int(k)].as_py() for k in at]) @ shared.value[d][:, :GRID_AXES]
                for k, c in zip(at, np.floor(y / eps).astype(np.int32)):
                    cells[k] = c.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cells, pa.list_(pa.int32())), batch.column(3)], schema=schema)

    return run


_INTERVAL = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("dim", pa.int32()), ("reps", pa.binary()), ("mults", pa.binary()), ("vecs", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
_INTERVAL_SQL = "part long, seq long, dim int, reps binary, mults binary, vecs binary, lo array<double>, hi array<double>"


def _packed(raws: list[bytes]) -> bytes:
    """Doubles as single floats where that loses nothing, as it does not for vectors that were stored so."""
    x = np.frombuffer(b"".join(raws), np.float64)
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small.tobytes() if (small == x).all() else x.tobytes()


def _unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64 if len(raw) == 8 * n * dim else np.float32).astype(np.float64).reshape(n, dim)


def _intervals(shared, size: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq, held, dim = TaskContext.get().partitionId(), 0, [], None

        def flush():
            nonlocal seq, held
            y = _units([r[2] for r in held]) @ shared.value[dim]
            row = (part, seq, dim, np.array([r[0] for r in held], np.int64).tobytes(), np.array([r[1] for r in held], np.int64).tobytes(), _packed([r[2] for r in held]), y.min(0).tolist(), y.max(0).tolist())
            seq, held = seq + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _INTERVAL.types)], schema=_INTERVAL)

        for batch in batches:
            for rep, mult, d, vec in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (d != dim or len(held) >= size):
                    yield flush()
                dim = d
                held.append((rep, mult, vec))
        if held:
            yield flush()

    return run


def near_pairs(left: tuple, right: tuple | None, eps: float, leaf: int = 32):
    """Recursive join of two runs of a sequence, or of one with itself: arrays of index pairs that may hold a link.

    A run: (dimensions, lower corners, upper corners), the corners padded with zeros. Two parts whose
    hulls are further apart than ``eps``, or of different dimensions, are skipped together."""
    same = right is None
    (da, la, ha), (db, lb, hb) = left, left if same else right

    def apart(a, b, c, e) -> bool:
        if da[a:b].max() < db[c:e].min() or db[c:e].max() < da[a:b].min():
            return True
        gap = np.maximum(0, np.maximum(la[a:b].min(0) - hb[c:e].max(0), lb[c:e].min(0) - ha[a:b].max(0)))
        return float(gap @ gap) > eps * eps + 1e-9

    todo = [(0, len(da), 0, len(db))]
    while todo:
        a, b, c, e = todo.pop()
        diagonal = same and (a, b) == (c, e)
        if not diagonal and apart(a, b, c, e):
            continue
        if b - a <= leaf and e - c <= leaf:
            gap = np.maximum(0, np.maximum(la[a:b, None] - hb[None, c:e], lb[None, c:e] - ha[a:b, None]))
            near = ((gap * gap).sum(2) <= eps * eps + 1e-9) & (da[a:b, None] == db[None, c:e])
            x, y = np.nonzero(near)
            x, y = x + a, y + c
            if diagonal:
                x, y = x[x <= y], y[x <= y]
            yield x, y
        elif diagonal:
            m = (a + b) // 2
            todo += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
        elif b - a >= e - c:
            m = (a + b) // 2
            todo += [(a, m, c, e), (m, b, c, e)]
        else:
            m = (c + e) // 2
            todo += [(a, b, c, m), (a, b, m, e)]


def _corners(rows, width: int = BOX_AXES) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        r = [x for x in r if x is not None]
        out[k, : len(r)] = r
    return out


_PAIR = pa.schema([("i", pa.int64()), ("j", pa.int64())])


def _box_pairs(eps: float):
    """Pairs of intervals, from rows of two chunks of boxes (or of one chunk, the other null)."""

    def load(boxes):
        return np.array([b["at"] for b in boxes]), (np.array([b["dim"] for b in boxes]), _corners([b["lo"] for b in boxes]), _corners([b["hi"] for b in boxes]))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at, left = load(batch.column(0)[k].as_py())
                other = batch.column(1)[k].as_py()
                at2, right = (at, None) if other is None else load(other)
                for x, y in near_pairs(left, right, eps):
                    if len(x):
                        i, j = at[x], at2[y]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], schema=_PAIR)

    return run


def link_blocks(left: tuple, right: tuple | None, t: float, axis: np.ndarray, block: int = BLOCK):
    """Links inside one interval, or between two: (counts left, counts right, edges of ids).

    An interval: (ids, multiplicities, unit vectors)."""
    eps = float(np.sqrt(2 - 2 * t)) + 1e-9
    same = right is None
    (ia, ma, ua), (ib, mb, ub) = left, left if same else right
    ya, yb = ua @ axis, ub @ axis
    fa, fb = ua.astype(np.float32), ub.astype(np.float32)
    ca, cb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    edges = []
    starts_b = list(range(0, len(ib), block))
    lo_b, hi_b = np.array([yb[c : c + block].min(0) for c in starts_b]), np.array([yb[c : c + block].max(0) for c in starts_b])
    for a in range(0, len(ia), block):
        lo, hi = ya[a : a + block].min(0), ya[a : a + block].max(0)
        gap = np.maximum(0, np.maximum(lo - hi_b, lo_b - hi))
        for k in np.flatnonzero((gap * gap).sum(1) <= eps * eps):
            c = starts_b[k]
            if same and c < a:
                continue
            x, y = np.nonzero(fa[a : a + block] @ fb[c : c + block].T >= t - 1e-4)
            x, y = x + a, y + c
            if same:
                x, y = x[x < y], y[x < y]
            exact = np.einsum("ij,ij->i", ua[x], ub[y]) >= t
            x, y = x[exact], y[exact]
            np.add.at(ca, x, mb[y])
            np.add.at(cb, y, ma[x])
            edges += zip(x.tolist(), (y if same else y + len(ia)).tolist())
            if len(edges) > 200_000:
                edges = union_find(len(ia) + (0 if same else len(ib)), edges)
    ids = np.concatenate((ia, ib)) if not same else ia
    kept = union_find(len(ids), edges)
    return (ca + cb, None, [(int(ids[p]), int(ids[q])) for p, q in kept]) if same else (ca, cb, [(int(ids[p]), int(ids[q])) for p, q in kept])


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _join(shared, t: float):
    """Rows of tiles, the pairs of a tile (null vectors) before its intervals: rows (a, b, null) are edges, (a, null, n) link counts."""

    def load(row):
        _, _, _, at, _, dim, reps, mults, vecs = row
        ids = np.frombuffer(reps, np.int64)
        u = _unpacked(vecs, len(ids), dim)
        u = u / np.abs(u).max(1, keepdims=True)
        return at, dim, (ids, np.frombuffer(mults, np.int64), u / np.sqrt((u * u).sum(1, keepdims=True)))

    def done(pairs, own):
        counts: dict[int, int] = {}
        edges = []
        for i, j in pairs:
            dim, left = own[i]
            ca, cb, found = link_blocks(left, None if i == j else own[j][1], t, shared.value[dim])
            edges += found
            for ids, c in ((left[0], ca), (own[j][1][0], cb)):
                for k in np.flatnonzero(c) if c is not None else ():
                    counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(c[k])
        place = {x: k for k, x in enumerate(sorted({x for e in edges for x in e}))}
        names = list(place)
        edges = [(names[p], names[q]) for p, q in union_find(len(names), [(place[p], place[q]) for p, q in edges])]
        a, b, n = [e[0] for e in edges] + list(counts), [e[1] for e in edges] + [None] * len(counts), [None] * len(edges) + list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], schema=_LINK)

    def run(batches):
        tile, pairs, own = None, [], {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                if (row[0], row[1]) != tile:
                    if pairs:
                        yield done(pairs, own)
                    tile, pairs, own = (row[0], row[1]), [], {}
                if row[2] == 0:
                    pairs.append((row[3], row[4]))
                else:
                    at, dim, held = load(row)
                    own[at] = (dim, held)
        if pairs:
            yield done(pairs, own)

    return run


def near_duplicates(vectors: DataFrame, t: float = THRESHOLD, interval: int = INTERVAL, tile: int = TILE, chunks: int = CHUNKS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * t))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(_valid, _VEC_SQL), "vectors")
    key = ["dim", "h1", "h2"]
    one = rows.where("vec is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    one = written(one, "distinct")
    axis = spark.sparkContext.broadcast(axes(one))
    cells = one.select("rep", "mult", "dim", "vec").mapInArrow(_cells(axis, eps), "rep long, mult long, dim int, cell array<int>, vec binary")
    order = ["dim", "cell", "rep"]
    cut = cells.repartitionByRange(*order).sortWithinPartitions(*order).select("rep", "mult", "dim", "vec").mapInArrow(_intervals(axis, interval), _INTERVAL_SQL)
    cut = written(cut, "intervals")
    found = written(_links(cut, axis, eps, t, tile, chunks), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    classes = one.select(*key, "rep", "mult").join(counts, "rep", "left").join(joined, "rep", "left")
    classes = classes.select(*key, (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("comp", "rep").alias("component"))
    out = rows.select("vec_id", *key).join(classes, key, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(cut: DataFrame, axis, eps: float, t: float, tile: int, chunks: int) -> DataFrame:
    """Edges and link counts of the written intervals.

    The recursion begins on the driver with the hulls of at most about ``chunks`` runs of intervals, whatever
    the input, and goes on in tasks for each pair of runs that is left. Pairs of intervals are
    dealt in tiles of ``tile`` by ``tile``, so an interval is sent once to a tile and not for each pair."""
    spark = cut.sparkSession
    sizes = {r[0]: r[1] for r in cut.groupBy("part").count().collect()}  # one row for each partition of the sort
    n, first = 0, {}
    for p in sorted(sizes):
        first[p], n = n, n + sizes[p]
    if not n:
        return spark.createDataFrame([], "a long, b long, n long")
    place = spark.createDataFrame(list(first.items()), "part long, first long")
    cut = cut.join(F.broadcast(place), "part").withColumn("at", F.col("first") + F.col("seq"))
    run = max(1, -(-n // chunks))
    boxes = cut.select("at", "dim", "lo", "hi", F.floor(F.col("at") / run).alias("chunk"))
    hull = lambda f, c: F.array(*[f(F.get(F.col(c), F.lit(k))) for k in range(BOX_AXES)]).alias(c)
    hulls = boxes.groupBy("chunk", "dim").agg(hull(F.min, "lo"), hull(F.max, "hi")).orderBy("dim", "chunk").collect()
    runs = (np.array([r.dim for r in hulls]), _corners([r.lo for r in hulls]), _corners([r.hi for r in hulls]))
    met = sorted({tuple(sorted((hulls[i].chunk, hulls[j].chunk))) for x, y in near_pairs(runs, None, eps + 1e-9) for i, j in zip(x.tolist(), y.tolist())})
    lists = written(boxes.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "dim", "lo", "hi"))).alias("boxes")), "boxes")
    pairs = spark.createDataFrame(met, "i long, j long").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.join(lists.select(F.col("chunk").alias("i"), F.col("boxes").alias("left")), "i").join(lists.select(F.col("chunk").alias("j"), F.col("boxes").alias("right")), "j")
    pairs = written(pairs.select("left", F.when(F.col("i") != F.col("j"), F.col("right"))).mapInArrow(_box_pairs(eps + 1e-9), "i long, j long"), "pairs")
    tiled = pairs.select(F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("j") / tile).alias("tj"), "i", "j")
    needs = tiled.select("ti", "tj", F.explode(F.array("i", "j")).alias("at")).distinct()
    sent = needs.join(cut.select("at", "dim", "reps", "mults", "vecs"), "at")
    none = F.lit(None)
    heads = tiled.select("ti", "tj", F.lit(0).alias("kind"), F.col("i").alias("at"), "j", none.cast("int").alias("dim"), *[none.cast("binary").alias(c) for c in ("reps", "mults", "vecs")])
    rows = heads.unionByName(sent.select("ti", "tj", F.lit(1).alias("kind"), "at", none.cast("long").alias("j"), "dim", "reps", "mults", "vecs"))
    rows = rows.repartition("ti", "tj").sortWithinPartitions("ti", "tj", "kind", "at", "j")
    # intervals are large rows: few of them at a time go to a worker
    with few_rows(spark):
        return written(rows.mapInArrow(_join(axis, t), "a long, b long, n long"), "found")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
