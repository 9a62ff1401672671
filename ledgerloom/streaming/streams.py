"""Structured Streaming forms of the batch operators: page ingest, usage meter, decisions, run status.

State is bounded by watermarks or keyed by documents and learned mappings. Sinks are idempotent per batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import pages as P
from ..operators.learning import DEMOTED_AT, PROMOTE_AT, PROMOTED_CONFIDENCE
from ..operators.state import DEMOTED_CONFIDENCE, MANUAL_CONFIDENCE as NEW_CONFIDENCE


def page_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Pages arriving as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest_pages(pages: DataFrame, event_time: str = "arrived_at", delay: str = "1 hour") -> DataFrame:
    """Classified pages with their sections and scope; pages delivered again within the delay are dropped.

    Stateless but for the duplicate check, whose keys leave the state with the watermark.
    """
    once = pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["document_id", "page_number"])
    return P.assign_sections(P.classify_pages(once)).withColumn("scope", X.detect_scope("text"))


def usage_meter(usage: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Tokens, calls and cost per window, stage and model; later events than the delay are dropped."""
    u = usage.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("model", X.model_id("model")).withWatermark("ts", delay)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return _metered(u.groupBy(w.alias("w"), "stage", "model"))


def usage_sessions(usage: DataFrame, gap: str = "6 hours", delay: str = "2 hours") -> DataFrame:
    """The same per session of a document's use."""
    u = usage.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("model", X.model_id("model")).withWatermark("ts", delay)
    return _metered(u.groupBy(F.session_window("ts", gap).alias("w"), "document_id", "stage", "model"))


def _metered(grouped) -> DataFrame:
    g = grouped.agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = X.call_cost("model", "input_tokens", "output_tokens")
    keep = [c for c in g.columns if c != "w"]
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keep,
                    F.coalesce(cost, F.lit(0.0)).alias("cost_usd"), cost.isNull().alias("unknown_pricing"))


def learning_counters(events: DataFrame) -> DataFrame:
    """Running counters per learned mapping from (learned_id, kind) events, for an update-mode sink.

    Counts are combined before the exchange, so a mapping used in a third of all events is no bottleneck;
    promotion and demotion follow from the counts.
    """
    g = events.groupBy("learned_id").agg(F.count_if(F.col("kind") == "applied").alias("times_applied"),
                                         F.count_if(F.col("kind") == "overridden").alias("times_overridden"))
    promoted = (F.col("times_applied") >= PROMOTE_AT) & (F.col("times_overridden") == 0)
    return g.withColumn("learned_confidence", F.when(F.col("times_overridden") >= DEMOTED_AT, DEMOTED_CONFIDENCE)
                        .when(promoted, PROMOTED_CONFIDENCE).otherwise(NEW_CONFIDENCE))


DECISION_KEYS = ["document_id", "extraction_id"]


def _last_decision(decisions: DataFrame) -> DataFrame:
    d = F.struct("action", "coa_id", "decided_at", "decision_id")
    return decisions.groupBy(*DECISION_KEYS).agg(F.max_by(d, F.struct("decided_at", "decision_id")).alias("d")).select(*DECISION_KEYS, "d.*")


def apply_decisions(decisions: DataFrame, table: str, checkpoint: str, available_now: bool = True):
    """Decisions into a table of changes, one folder per batch holding the last decision per row in it.

    A batch writes only its own folder, and a repeated batch rewrites the same one, so a restart changes
    nothing. `current_decisions` reads the state, `compact_decisions` writes it as a new table.
    """
    def keep(batch: DataFrame, epoch: int) -> None:
        _last_decision(batch).write.mode("overwrite").parquet(os.path.join(table, f"batch={epoch}"))

    w = decisions.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current_decisions(spark: SparkSession, table: str) -> DataFrame:
    """The last decision per row over all batches."""
    return _last_decision(spark.read.parquet(table))


def compact_decisions(spark: SparkSession, table: str, target: str) -> None:
    current_decisions(spark, table).write.mode("overwrite").parquet(target)


def latest_stage(events: DataFrame) -> DataFrame:
    """Latest stage per document, for an update-mode sink."""
    return events.groupBy("document_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("ts"))


def run_to_end(stream: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Process what is there and stop; complete and update results are written per batch."""
    if mode == "append":
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={epoch}"))

        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
