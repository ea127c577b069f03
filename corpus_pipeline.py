"""Corpus pipeline: quality classifier, near-duplicates, decontamination, source mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mix, quality, shards, simhash, tiling
from tessera.llm.common import save, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier rejects; it learns from the labelled ones among docs."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs, net)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies (five words, similarity 0.8)."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold half or more of a benchmark item."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may come twice."""
    return mix.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the number of one of 8 contiguous shards of near-equal bytes."""
    return shards.shard_documents(docs)


STAGES = [("quality", good_quality), ("near_dedup", near_deduplicated), ("decontaminate", decontaminated), ("mix", mixed), ("shard", sharded)]
#: Learned, iterated and hashed stages: SQL can't express them; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
