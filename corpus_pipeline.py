"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugewell.llm import byte_bpe, exact_dedup, language, mixing, simhash
from gaugewell.llm.common import last_only, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language go (null text or no letter); of all others ``lang`` becomes the language found."""
    return language.identified(docs, language.train(language.training_rows(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, null ids lowest; of rows that repeat it one. Null counts as
    empty."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays, null ids last; of rows that repeat it one.
    Texts without words are copies of each other."""
    return simhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row appears as often as a shard draws it, at most twice. A null source is
    one of its own."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language, source, number of tokens and digests of ids and decoded bytes of every row of the mix."""
    return byte_bpe.round_trip(docs, more=("lang", "source"), corpus_pieces=40_000)  # the JVM's heap is full after the mix


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the learned language model, SimHash components, the seeded mix or BPE; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again. Every stage takes an
    empty table, nulls in any column, repeated rows and texts of any length. Only the result's files are left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with last_only(spark):
        for _, stage in STAGES:
            with last_only(spark):
                docs = materialize(stage(spark, docs, sf_dir))
    return docs
