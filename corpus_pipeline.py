"""Cleaning, deduplicating, mixing and packing a corpus: STAGES in order, each reading what the one before has written.

Defined results: null and empty texts are scored by the toxicity model like others, have no copies and no passages, and pack as their
end token alone; rows without an id stay through the duplicate stages; rows that repeat an id stay or go together; an empty table
gives no rows; columns are kept whatever their names, up to packing, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factorseg.llm import jaccard_join, mixing, packing, substring_dedup, toxicity, words
from factorseg.operators.lineage import checkpoint_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones among them."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by Jaccard 0.8 of five-word shingles."""
    return jaccard_join.keep_first(docs, k=5, similarity=(4, 5))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 or more words that an earlier document, or the same one before, has."""
    return substring_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, at least once, written in the order of the mixture."""
    order = mixing.mixed(docs).repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return order.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all texts with their places in sequences of 2048 tokens."""
    return packing.packed(docs, window=2048)


STAGES = [("toxicity", without_toxic), ("jaccard_join", without_near_copies), ("substring_dedup", without_repeats),
          ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None  # the toxicity model is trained


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        with words.small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
