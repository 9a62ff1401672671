"""Texts that are no UTF-8, and operators over rows of equal content."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import contamination
from ledgerloom.llm.language import identify
from ledgerloom.llm.ngram_join import ngram_join
from ledgerloom.llm.sharding import shard
from ledgerloom.llm.toxicity import toxicity


def broken(spark):
    words = F.concat(F.lit("some plain words of number "), F.col("id").cast("string"), F.lit(" and a bad one: "), F.expr("cast(X'C3FF61' as string)"))
    return spark.range(60).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))


def test_language_and_toxicity_take_malformed_text(spark):
    docs = broken(spark)
    assert {r.lang_pred for r in identify(docs).collect()} == {"en"}
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert toxicity(docs, labels).count() == 60


def test_others_take_malformed_text(spark):
    docs = broken(spark)
    assert ngram_join(docs).count() == 60 and shard(docs, 500).count() == 60
    items = spark.createDataFrame([(1, "an item of some twenty words that no document of this small table holds anywhere at all in any of its lines")], "item_id long, text string")
    assert contamination(docs, items).count() in (0, 60)


def test_codes_of_runs_agree_beyond_64_bits(spark):
    from ledgerloom.llm.decontaminate import Index

    index = Index.__new__(Index)
    index.base = 3_000_017
    run = np.array([2_999_999, 2_900_000, 2_800_001], np.int64)
    value = np.zeros(1, np.int64)
    for w in run:
        value = value * index.base + w + 1
    assert index.code(run) == int(value[0])
