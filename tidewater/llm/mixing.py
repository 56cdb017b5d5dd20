"""Mixing sources to target weights by capped water-filling.

Defined cases: a null text has size 0; null is a source of its own and comes last;
a source of size 0 has target 0; repeated rows count each on its own; an empty table
gives an empty mix; extra columns are ignored or, in ``mixed``, kept whatever their names;
equal rows (id, text and source) are taken one by one, and which of them is no matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, table, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240229
BUCKETS = 4096


def water_fill(sources: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """``sources(source, source_size)`` with ``weight`` and ``target``.

    Sources take the weights in turn by code point, null last. All of the words are
    shared by weight; a source above ``max_epochs`` times its size is clamped there
    and the excess goes to the others by weight, until none is above. Each step is a
    sum over the table of sources, so nothing but one row reaches the driver.
    """
    placed = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "sources")
    part = F.shiftright("at", 33)
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # one row for each partition
    first, offsets = 0, {}
    for p in sorted(counts):
        offsets[p], first = first, first + counts[p]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (offsets or {0: 0}).items() for x in kv]), part), F.lit(0)) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(len(weights))) + 1).cast("int"))
    placed = placed.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = float(placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = None
    while True:
        clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        fixed, share, n = placed.agg(F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)), F.count(F.when(clamped, 1))).first()
        if level is not None and n == before:
            break
        before, level = n, (total - fixed) / share if share else 0.0
    return placed.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


_KEY = ("source", "bucket", "h", "doc_id", "size")


def _met(rows: DataFrame, keys: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Equi-join on equal or null ``on``; the other columns of both sides stay."""
    other = keys.select(*[F.col(c).alias(f"{c}_") if c in on else F.col(c) for c in keys.columns])
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in on]).drop(*[f"{c}_" for c in on])


def mix_rows(docs: DataFrame, columns: list, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED, buckets=BUCKETS) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken, copies, and ``row``, a struct of ``columns``.

    A source is taken whole as often as its target holds it; the rest is a seeded
    sample: rows in the order of a seeded hash until the rest is used up. The order is
    found in levels: sums by hash bucket; sums by distinct (id, size, text) in the one
    bucket where a source's sample ends; and, if it ends inside a group of copies, numbers
    by file of the written rows. No level puts a hot source or a group of copies in one task.
    """
    kept = F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))
    text = F.col("text").cast("string")
    sizes = docs.select(
        kept.alias("row"),
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("h"),
    )
    sizes = written(sizes.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")), "sizes")
    sums = written(sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "bucket-sums")
    filled = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("whole", ratio).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = _met(sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))), filled, ("source",))
    # buckets are taken in order, so a source is told by the first bucket that does not fit and the room there
    plan = plan.withColumn("left", F.col("rest") - F.col("before"))
    first = F.min_by(F.struct(F.col("bucket").alias("cut"), F.col("left").alias("room")), F.when(F.col("left") < F.col("words"), F.col("bucket")))
    plan = plan.groupBy("source").agg(first.alias("first"), *[F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest")])
    # written, its size is known: a table of sources below the threshold is broadcast, and no text is shuffled
    plan = written(plan.select("source", F.col("source_size").cast("long").alias("source_size"), "target", "whole", "rest", F.coalesce("first.cut", F.lit(buckets)).alias("cut"), F.coalesce("first.room", F.lit(0.0)).alias("left")), "mix-plan")
    rows = _met(sizes.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")), plan, ("source",))
    ends = (F.col("bucket") == F.col("cut")) & (F.col("left") > 0)
    inside = (F.col("bucket") < F.col("cut")) & (F.col("rest") > 0)
    sure = rows.where(~ends).withColumn("extra", F.when(inside, 1).otherwise(0))
    cut = rows.where(ends)
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    keys = cut.groupBy(*_KEY).agg(F.count("*").alias("n"), F.first("left").alias("room"))
    keys = keys.withColumn("room", F.col("room") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)))
    # the copy i of n is in if more than half of it fits; words of size 0 are in wherever room is left
    fits = F.when(F.col("size") > 0, F.floor(F.col("room") / F.col("size") + 0.5)).otherwise(F.when(F.col("room") > 0, F.col("n")).otherwise(0))
    keys = written(keys.select(*_KEY, "n", F.least("n", F.greatest(fits, F.lit(0))).cast("long").alias("m")), "cut-keys")
    clear = (F.col("m") == 0) | (F.col("m") == F.col("n"))
    whole = _met(cut, keys.where(clear), _KEY).withColumn("extra", F.when(F.col("m") > 0, 1).otherwise(0))
    part = _met(cut, keys.where(~clear), _KEY)
    files = part.groupBy(*_KEY, "file").agg(F.count("*").alias("c"))
    files = files.withColumn("first", F.coalesce(F.sum("c").over(Window.partitionBy(*_KEY).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy(*_KEY, "file").orderBy("at"))
    part = _met(part, files.drop("c"), (*_KEY, "file")).withColumn("extra", F.when(F.col("first") + number <= F.col("m"), 1).otherwise(0))
    names = ["row", "doc_id", "source", "size", "source_size", "target", "whole", "extra"]
    both = sure.select(*names).unionByName(whole.select(*names)).unionByName(part.select(*names))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return both.select(*names[:6], (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken, copies."""
    return mix_rows(docs, [], **options).drop("row")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the copies are decided on the row itself."""
    rows = mix_rows(docs, columns_of(docs), **options).where("copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
