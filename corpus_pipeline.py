"""From documents to a sharded training corpus, in five stages.

Each stage works on all that its predecessor kept.  The first four return rows
with the columns of documents; the last returns them dealt into shards, each row
with its shard and slot.  Every stage takes an empty table, and columns of any
name beside those of documents, which come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, mixing, quality, sharding, simhash
from plumbline.llm.common import stage_table, table
from plumbline.session import delete_folder, ship

#: Part of the tokens that the mix may take.
MIX_NUMERATOR, MIX_DENOMINATOR = 9, 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the band of their language; null and empty texts go, repeated rows get equal verdicts, a null language takes its script's band."""
    ship(spark)
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with its least doc_id. Texts without a word are one class; rows that share an id or have none are told apart by fingerprint."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item; null and empty texts leak none, very long ones are searched whole, repeated rows stay or go together."""
    ship(spark)
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows within their leaf's budget, in the order of their ids, then texts; null languages and sources are a leaf of their own, rows without words cost nothing."""
    return mixing.mix_rows(docs, MIX_NUMERATOR, MIX_DENOMINATOR)


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; sizes of shards differ by one at most, whatever ids and texts are equal or null. A column that has a name of the digest's gets ``in_`` before it."""
    return sharding.shard_rows(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard_corpus", shard_corpus),
]

#: SQL can express neither the tokeniser's figures nor the drawn matrix; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written as Parquet to the shared folder and read again.

    A stage's folder goes when its successor is written.  That of the last but one stays, as the result reads it.
    """
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stage_table(stage(spark, docs, sf_dir), name)
        if old:
            delete_folder(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
