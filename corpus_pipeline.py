"""The corpus pipeline: five stages, each one operator over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet to the shared folder and read again as the next one's docs.  All but
the last return the columns of documents.  The mix is random (by a fixed seed), so
no SQL says the rows of run(); tests hold each stage against a plain version.

Python tasks get texts in batches of `BATCH` rows: what larger batches take in the workers and beside
the JVM's heap stays taken in part while later stages run.  A session with a number other than Spark's keeps it.

Cases follow the operators: NULL and empty texts fail the quality rules, an empty
table passes through all stages as an empty one, further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mendframe.llm import host_rules, jaccard, line_dedup, mixing, packing
from mendframe.session import materialize

BATCH = 1000
DEFAULT_BATCH = "10000"  # Spark's
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """The number is read when a stage is written, so it is set for the session, and holds for what follows."""
    if spark.conf.get(BATCH_SETTING) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, BATCH)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    small_batches(spark)
    return host_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one document only."""
    small_batches(spark)
    return line_dedup.without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that is linked by similarity 0.8 on five-word shingles.

    SimHash fingerprints bring texts together first; pairs that they miss are found by shared shingles.
    """
    small_batches(spark)
    return jaccard.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    small_batches(spark)
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
