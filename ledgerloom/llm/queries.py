"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.ann import nearest
from ledgerloom.llm.centroids import oracle as centroids_oracle
from ledgerloom.llm.centroids import report
from ledgerloom.llm.common import held_out, table
from ledgerloom.llm.decontaminate import contamination
from ledgerloom.llm.fim import ORACLE as FIM_ORACLE
from ledgerloom.llm.fim import digests as fim_digests
from ledgerloom.llm.language import identify
from ledgerloom.llm.licences import scan
from ledgerloom.llm.line_runs import ORACLE as LINES_ORACLE
from ledgerloom.llm.line_runs import digests as line_digests
from ledgerloom.llm.mixing import block_order, plan
from ledgerloom.llm.ngram_join import ngram_join
from ledgerloom.llm.sharding import oracle as sharding_oracle
from ledgerloom.llm.sharding import shard
from ledgerloom.llm.toxicity import toxicity
from ledgerloom.llm.urls import judge
from ledgerloom.llm.urls import oracle as urls_oracle
from ledgerloom.llm.warc import ORACLE as WARC_ORACLE
from ledgerloom.llm.warc import round_trip


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_small_world_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), rate=False).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op6_benchmark_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "shard", "depth", "n_bytes")


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_order(plan(table(spark, sf_dir, "documents"))[0])


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op11_subvector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "embeddings"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (op1_toxic_segments, op2_small_world_neighbours, op3_language_kernel, op4_licence_paragraphs, op5_arc_to_warc, op6_benchmark_edits, op7_redirect_rules, op8_extendible_shards, op9_temperature_mix, op10_ngram_jaccard_join, op11_subvector_centroids, op12_line_runs, op13_fill_in_middle)}

ORACLES: dict[str, str] = {"op5_arc_to_warc": WARC_ORACLE, "op7_redirect_rules": urls_oracle(), "op8_extendible_shards": sharding_oracle(), "op11_subvector_centroids": centroids_oracle(), "op12_line_runs": LINES_ORACLE, "op13_fill_in_middle": FIM_ORACLE}
