"""A corpus pipeline of five operators: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import decontaminate, line_frequency, mixing, near_dup, sharding
from terrane.llm.common import Scratch, read

#: Domains' tokens in the mix, as a share of those they have: good text more often than plain text, none of both less than once, toxic text not.
TARGETS = mixing.Mix(weights=(1.25, 1.1, 0.02))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, and common lines from the others."""
    return line_frequency.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dup.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten words in a row, or a whole shorter item, of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the target weights of the domains ask: toxic ones not, others once or twice."""
    return mixing.clean(docs, read(spark, sf_dir, "labels"), TARGETS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns each document a shard and its place there."""
    return sharding.assign(docs)


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing to target weights", mixed), ("sharding", sharded)]

#: SQL can express neither the mixing stage nor the slot map; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, "stage")
    return docs
