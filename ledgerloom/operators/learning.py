"""Learned mappings: lookup, feedback, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import materialise
from .ordered import running
from .textjoin import contains_join

DEMOTED_AT = 2
PROMOTE_AT = 5
PROMOTED_CONFIDENCE = 0.99


def learned_lookup(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """Learned mapping of each row (document_id, extraction_id, raw_label, statement_type, template_type).

    Own template, then any template, then a stored label that contains the row's key; newest first.
    Demoted mappings are out. The newest mapping per stored key is taken before the join, and the lookup runs
    once per distinct (label, statement, template). Those and what is found for them are written, so that keys are made
    once per label and the rows stay where they are unless that is large.
    """
    raw = ["raw_label", "statement_type", "template_type"]
    lines = materialise(rows.select(*raw).distinct().withColumn("label_key", X.label_key("raw_label")).filter("label_key <> ''"))
    wanted = lines.select("label_key", "statement_type", "template_type").distinct()
    live = learned.filter(F.col("times_overridden") < DEMOTED_AT)
    age = F.struct("created_seq", "learned_id")
    pick = F.struct("learned_id", "coa_id", F.col("learned_confidence").alias("confidence"), "times_applied", "times_overridden")
    newest = live.groupBy("label_key", "statement_type", F.col("template_type").alias("_tt")).agg(F.max_by(pick, age).alias("m"), F.max(age).alias("age"))
    keys = ["label_key", "statement_type", "template_type"]
    tier = F.when(F.col("_tt") == "*", 2).otherwise(1)
    exact = (newest.join(wanted, ["label_key", "statement_type"]).filter(F.col("_tt").isin("*") | (F.col("_tt") == F.col("template_type")))
             .groupBy(*keys).agg(F.min(tier).alias("tier"), F.min_by("m", tier).alias("m")))
    rest = wanted.join(exact, keys, "left_anti")
    patterns = newest.groupBy(F.col("label_key").alias("pattern"), "statement_type").agg(F.max_by("m", "age").alias("m"), F.max("age").alias("age"))
    keys_only = rest.select("label_key", "statement_type").distinct()
    fuzzy = contains_join(patterns, "pattern", keys_only, "label_key", ["statement_type"]).groupBy("label_key", "statement_type").agg(
        F.max_by("m", "age").alias("m"))
    loose = rest.join(fuzzy, ["label_key", "statement_type"]).select(*keys, F.lit(3).alias("tier"), "m")
    found = exact.select(*keys, "tier", "m").unionByName(loose).select(*keys, "tier", "m.*")
    found = materialise(lines.join(found, keys))
    return rows.join(found, raw)


def apply_learning_feedback(hits: DataFrame, learned: DataFrame, applied_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the count and confidence they saw, learned mappings after the run).

    Inside a document the count grows row by row: the k-th use of a mapping sees k-1 earlier ones, and once
    five uses without an override are reached the following rows see the promoted confidence. With `applied_at`,
    a column of the hits, the mappings' last_applied_at moves up to their latest use.
    """
    seen = running(hits, ["document_id", "learned_id"], "extraction_id", {"_before": ("sum", F.lit(1))})
    count = F.col("times_applied") + F.col("_before")
    promoted = (F.col("_before") > 0) & (count >= PROMOTE_AT) & (F.col("times_overridden") == 0)
    seen = seen.withColumns({"times_seen": count.cast("bigint"),
                             "confidence_seen": F.when(promoted, PROMOTED_CONFIDENCE).otherwise(F.col("confidence"))}).drop("_before")
    latest = F.lit(None).cast("timestamp") if applied_at is None else F.max(F.col(applied_at)).cast("timestamp")
    uses = hits.groupBy("learned_id").agg(F.count(F.lit(1)).alias("_uses"), latest.alias("_at"))
    after = learned.join(uses, "learned_id", "left")
    total = F.col("times_applied") + F.coalesce("_uses", F.lit(0))
    promote = F.col("_uses").isNotNull() & (total >= PROMOTE_AT) & (F.col("times_overridden") == 0)
    after = after.withColumns({"learned_confidence": F.when(promote, PROMOTED_CONFIDENCE).otherwise(F.col("learned_confidence")),
                               "times_applied": total.cast("bigint")})
    if applied_at is not None:
        known = F.col("last_applied_at").cast("timestamp") if "last_applied_at" in learned.columns else F.lit(None).cast("timestamp")
        after = after.withColumn("last_applied_at", F.greatest(known, F.col("_at")))
    after = after.drop("_uses", "_at")
    return seen, after


def attribution(source: str = "source_document", applied: str = "applied_on", rationale: str = "rationale",
                confidence: str = "learned_confidence", times: str = "times_applied") -> Column:
    """Sentence naming where a learned mapping comes from."""
    src = F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("a prior document"))
    return F.concat(F.lit("Mapped using analyst learning from "), src, F.lit(" (applied "), F.coalesce(F.col(applied).cast("string"), F.lit("")),
                    F.lit("). Original rationale: "), F.trim(F.coalesce(F.col(rationale), F.lit(""))), F.lit(" Confidence inherited: "),
                    F.col(confidence).cast("string"), F.lit(". Applied "), F.col(times).cast("string"), F.lit(" time(s) previously."))
