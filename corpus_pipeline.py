"""From raw documents to packed training sequences: five stages, each written and read again.

Quality classifier (documents that it rejects go), exact dedup (of equal texts one stays), near-dedup by five-word shingles (of each
group one document stays), benchmark decontamination (documents with benchmark passages go), packing (token pieces).
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontam, exact_dedup, neardup, packing, quality
from fieldloom.llm.common import release, stored, tidy


#: Rows that Spark hands to a Python worker at once, at most: documents are long, and each task holds a batch several times over.
ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage):
    """A stage for which the session's Arrow batches have at most ROWS rows; they stay so, since what it returns is not yet computed."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH)) <= ROWS:
            spark.conf.set(BATCH, str(ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@small_batches
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


@small_batches
def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs)


@small_batches
def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("simhash", apart), ("decontamination", unseen), ("packing", packed)]
#: The classifier's sampling and the fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces. What a stage has written is deleted once the next stage's table is committed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = stored(kept, name)
        release(spark, kept)
    return STAGES[-1][1](spark, docs, sf_dir)
