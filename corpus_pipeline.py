"""Corpus pipeline: stages of training-data operators, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import table
from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.language import keep_known
from ledgerloom.llm.mixing import mixed
from ledgerloom.llm.ngram_join import keep_one
from ledgerloom.llm.sharding import shard
from ledgerloom.session import materialise

#: Words of a shingle and least Jaccard similarity (per cent) of near duplicates.
WIDTH, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every language of the corpus, go."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays: the one with the smallest doc_id.

    Texts link when their sets of 5-word shingles have a Jaccard similarity of 0.8 at least.
    """
    return keep_one(docs, width=WIDTH, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source is passed over once at least; small ones are repeated up to twice in all."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, and the shard each row belongs to."""
    return shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The language model and the bucket walks are not SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
