"""The corpus pipeline: documents to balanced shards of a clean mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Stages handle nulls, repeated rows, empty tables
and further columns as their operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadlake.llm import decontaminate, language_id, minhash, mixing, sharding
from leadlake.llm.common import folder, stored, table

#: Near duplicates share this many per cent of their shingles.
SIMILAR_PERCENT = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.known_language(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_first(docs, percent=SIMILAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources: documents as often as their source's rate asks."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: Language ID is learned, which SQL does not express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is stored and read back."""
    path, docs = folder(spark, None), table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{path}/stage-{number}")
    return docs
