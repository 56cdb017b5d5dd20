"""Documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents,
extra ones included, whatever their names. An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import columns_of, table, written
from tidewater.llm.decontam import uncontaminated
from tidewater.llm.mixing import mixed
from tidewater.llm.ngram_join import PERCENT, WIDTH, jaccard_components
from tidewater.llm.tokens import token_rows
from tidewater.llm.toxicity import clean, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts stay. Without both classes among the labels all stay."""
    return clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, Jaccard 0.8) stays: the one with the smallest id.

    Documents without an id stay. Of rows that repeat an id and its text one stays.
    """
    found = jaccard_components(docs, width=WIDTH, percent=PERCENT).where("doc_id = component_id or doc_id is null")
    found = found.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.struct("doc_id", "n").alias("found"))
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"))
    met = rows.join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("found.doc_id")))
    alone = (F.col("found.n") == 1) | F.col("found.doc_id").isNull()
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    repeated = met.where(~alone).select(*columns).dropDuplicates(["doc_id", "text"])
    return met.where(alone).select(*columns).unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts stay."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it; rows of no words as often as those around them in the seeded order."""
    return mixed(docs)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in coded shards, and per row what the shards hold; null and empty texts are the end id alone."""
    return token_rows(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_binary", token_binary),
]

#: SQL can't train the classifier of the first stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
