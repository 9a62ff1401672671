"""Changes to stored tables: upserts, cascades, analyst decisions, republishing.

A table after a change is a new DataFrame; nothing is updated in place. Changes of several tables that belong
together are computed from the same decisions, so a rerun gives the same result.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from .coa import balance_identity, mapping_sources, outcomes
from .reconcile import crossfoot, group_subtotals

if TYPE_CHECKING:
    from ..sources.buckets import BucketTable

ROW = ["document_id", "extraction_id"]
MANUAL_CONFIDENCE = 0.95
DEMOTED_CONFIDENCE = 0.70


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `source` replace those of `target` with the same keys; new keys are added."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source, allowMissingColumns=True)


def merge_columns(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Update only the columns `source` has, and only where it has a value."""
    cols = [c for c in source.columns if c not in keys]
    s = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    return target.join(s, keys, "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in target.columns])


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append rows; an empty frame writes no files beyond the table's own."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame, learned: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of the deleted documents; learned mappings stay, their source document is cleared."""
    ids = gone.select("document_id").distinct()
    kept = {name: df.join(ids, "document_id", "left_anti") for name, df in tables.items()}
    flag = ids.select(F.col("document_id").alias("source_document_id"), F.lit(True).alias("_gone"))
    after = learned.join(flag, "source_document_id", "left").withColumn(
        "source_document_id", F.when(F.col("_gone").isNull(), F.col("source_document_id"))).select(*learned.columns)
    return kept, after


def _latest(decisions: DataFrame, action: str) -> DataFrame:
    """The last decision of a kind per row."""
    d = decisions.filter(F.col("action") == action)
    return d.groupBy(*ROW).agg(F.max_by(F.struct("coa_id", "decision_id"), F.struct("decided_at", "decision_id")).alias("d")).select(
        *ROW, F.col("d.coa_id").alias("new_coa_id"), F.col("d.decision_id").alias("decision_id"))


def learned_from(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """New learned mappings of decided rows, with ids derived from the decision."""
    d = documents.select("document_id", "template_type", F.col("filename").alias("source_document"))
    j = changes.join(d, "document_id", "left")
    return j.select(
        F.sha2(F.concat_ws("/", F.col("document_id").cast("string"), F.col("extraction_id").cast("string"), F.col("decision_id").cast("string")), 256).alias("learned_key"),
        X.label_key("raw_label").alias("label_key"), F.coalesce("template_type", F.lit("*")).alias("template_type"), "statement_type",
        F.col("new_coa_id").alias("coa_id"), F.lit(MANUAL_CONFIDENCE).alias("learned_confidence"), F.lit(0).alias("times_applied"), F.lit(0).alias("times_overridden"),
        F.coalesce("source_document", F.lit("")).alias("source_document"), F.col("document_id").alias("source_document_id"), "decision_id")


def resolve_items(routed: DataFrame, row_values: DataFrame, decisions: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Analyst decisions on pending rows, as the change of each table.

    rows: all rows after the decisions; values: unsigned values of the new manual mappings; learned: new
    learned mappings; documents: pending count and status; errors: decisions on rows that are not pending.
    """
    d = _latest(decisions, "resolve")
    items = routed.filter("status = 'unmapped'").select(*ROW, "raw_label", "statement_type")
    hit = d.join(items, ROW)
    rows = routed.join(hit.select(*ROW, "new_coa_id"), ROW, "left")
    done = F.col("new_coa_id").isNotNull()
    rows = rows.withColumns({
        "status": F.when(done, "mapped").otherwise(F.col("status")), "coa_id": F.coalesce("new_coa_id", "coa_id"),
        "confidence": F.when(done, MANUAL_CONFIDENCE).otherwise(F.col("confidence")),
        "mapping_source": F.when(done, "manual").otherwise(F.col("mapping_source"))}).select(*routed.columns)
    left = rows.groupBy("document_id").agg(F.count_if(F.col("status") == "unmapped").alias("unmapped_count"))
    return {
        "rows": rows,
        "values": row_values.join(hit.select(*ROW, F.col("new_coa_id").alias("coa_id")), ROW),
        "learned": learned_from(hit, documents),
        "documents": left.withColumn("spread_status", F.when(F.col("unmapped_count") == 0, "spread_complete").otherwise("has_unmapped")),
        "errors": d.join(items, ROW, "left_anti").select(*ROW, "decision_id", F.lit("item not found").alias("error")),
    }


def override_mappings(routed: DataFrame, learned: DataFrame, decisions: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Analyst corrections of mapped rows: rows re-pointed, the learned mappings behind them counted down, new ones added."""
    d = _latest(decisions, "override")
    mapped = routed.filter("status = 'mapped'").select(*ROW, "raw_label", "statement_type", "learned_id")
    hit = d.join(mapped, ROW)
    rows = routed.join(hit.select(*ROW, "new_coa_id"), ROW, "left")
    done = F.col("new_coa_id").isNotNull()
    rows = rows.withColumns({
        "coa_id": F.coalesce("new_coa_id", "coa_id"), "confidence": F.when(done, MANUAL_CONFIDENCE).otherwise(F.col("confidence")),
        "mapping_source": F.when(done, "manual").otherwise(F.col("mapping_source"))}).select(*routed.columns)
    n = hit.filter("learned_id IS NOT NULL").groupBy("learned_id").agg(F.count(F.lit(1)).alias("_n"))
    j = learned.join(n, "learned_id", "left")
    count = F.col("times_overridden") + F.coalesce("_n", F.lit(0))
    after = j.withColumns({
        "learned_confidence": F.when(F.col("_n").isNotNull() & (count >= 2), DEMOTED_CONFIDENCE).otherwise(F.col("learned_confidence")),
        "times_overridden": count.cast("bigint")}).drop("_n")
    return {"rows": rows, "learned": after, "new_learned": learned_from(hit, documents), "errors": d.join(mapped, ROW, "left_anti").select(*ROW, "decision_id")}


def skip_items(routed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending rows an analyst set aside."""
    d = decisions.filter("action = 'skip'").select(*ROW).distinct().withColumn("_skip", F.lit(True))
    return routed.join(d, ROW, "left").withColumn(
        "status", F.when(F.col("_skip") & (F.col("status") == "unmapped"), "set_aside").otherwise(F.col("status"))).drop("_skip")


def changed_documents(decisions: DataFrame) -> DataFrame:
    return decisions.select("document_id").distinct()


def refresh_checks(changed: DataFrame, rows: DataFrame, row_values: DataFrame, coa: DataFrame) -> DataFrame:
    """Balance identity of the changed documents only, from their rows as they are now (signs applied again)."""
    m = rows.join(changed, "document_id", "left_semi").filter("status = 'mapped'").select(*ROW, "coa_id")
    v = row_values.join(m, ROW).join(coa.select("coa_id", "sign_convention"), "coa_id", "left")
    return balance_identity(v.withColumn("value", X.signed("value", "sign_convention")), coa)


def refresh_reconciliation(changed: DataFrame, routed: DataFrame, rows: DataFrame, row_values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cross-foot of the changed documents only, from their rows and outcomes as they are now: (per year, report)."""
    r, v, o = (df.join(changed, "document_id", "left_semi") for df in (rows, row_values, routed))
    comps, subs = group_subtotals(r, v)
    return crossfoot(comps, subs, r, v, outcomes(o))


def refresh_stored(changed: DataFrame, rows: BucketTable, row_values: BucketTable, coa: DataFrame, balance: BucketTable) -> int:
    """Bring a stored balance table up to date after edits of some documents; its new version.

    All tables lie in buckets by document: only the changed documents' buckets are read, and only theirs written.
    """
    return balance.replace(changed, refresh_checks(changed, rows.lookup(changed), row_values.lookup(changed), coa))


def refresh_stored_reconciliation(changed: DataFrame, routed: BucketTable, row_values: BucketTable, report: BucketTable) -> int:
    """The same for the cross-foot report; `routed` has the rows with their levels and outcomes."""
    own = routed.lookup(changed)
    return report.replace(changed, refresh_reconciliation(changed, own, own, row_values.lookup(changed))[1])


def promoted_outcomes(before: DataFrame, promoted: DataFrame) -> DataFrame:
    """Outcomes by label in which a promoted row's label counts as mapped in its statement."""
    up = promoted.select("document_id", F.lower(F.trim("raw_label")).alias("label"), "statement_type").distinct().withColumn("_up", F.lit(True))
    j = before.join(up, ["document_id", "label", "statement_type"], "left")
    return j.withColumn("status", F.when(F.col("_up"), "mapped").otherwise(F.col("status"))).drop("_up")


def republish(routed: DataFrame, aggregated: DataFrame, heads: DataFrame, pending: DataFrame, row_values: DataFrame, coa: DataFrame,
              threshold: float = R.ROUTE_THRESHOLD) -> dict[str, DataFrame]:
    """Promote pending rows whose best suggestion reaches the threshold into the published mappings.

    rows: statuses after the run (auto_mapped); values: published values with the promoted, signed ones added;
    heads: one row per (document, chart line), new lines with the highest promoted score and, where `pending` has
    best_reason, its reason; sources: labels and row ids of every line, in parts of bounded size, the promoted ones after
    the mapped ones; balance: the identity over all published values; outcomes: the labels' outcomes with the promoted
    ones mapped; documents: status.
    """
    reason = F.coalesce("best_reason", F.lit("")) if "best_reason" in pending.columns else F.lit("")
    up = pending.filter((F.col("best_score") >= threshold) & F.col("best_coa_id").isNotNull() & (F.col("statement_type") != "equity_statement"))
    up = up.select(*ROW, "raw_label", "statement_type", F.col("best_coa_id").alias("coa_id"), "best_score", reason.alias("best_reason"))
    signs = coa.select("coa_id", "sign_convention")
    more = row_values.join(up.select(*ROW, "coa_id"), ROW).join(signs, "coa_id", "left").select(
        "document_id", "coa_id", "year", X.signed("value", "sign_convention").alias("value"))
    values = aggregated.select("document_id", "coa_id", "year", "value").unionByName(more).groupBy("document_id", "coa_id", "year").agg(F.sum("value").alias("value"))
    first = F.min_by(F.struct("raw_label", "statement_type"), "extraction_id")
    new = up.groupBy("document_id", "coa_id").agg(F.count(F.lit(1)).alias("_n"), F.max("best_score").alias("_score"), F.min("extraction_id").alias("_first"), first.alias("_f"),
                                                  F.max_by("best_reason", F.struct("best_score", -F.col("extraction_id"))).alias("_reason"))
    h = heads.select("document_id", "coa_id", "aggregated_from", "first_row", "raw_label", "statement_type", "confidence", "mapping_source", "rationale_note").join(new, ["document_id", "coa_id"], "full")
    promoted = F.trim(F.concat(F.col("_reason"), F.format_string(" [Threshold-promoted at %.2f.]", F.lit(threshold))))
    h = h.select("document_id", "coa_id", (F.coalesce("aggregated_from", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("aggregated_from"),
                 F.coalesce("first_row", "_first").alias("first_row"), F.coalesce("raw_label", "_f.raw_label").alias("raw_label"), F.coalesce("statement_type", "_f.statement_type").alias("statement_type"),
                 F.coalesce("confidence", "_score").alias("confidence"), F.coalesce("mapping_source", F.lit("model")).alias("mapping_source"),
                 F.when(F.col("aggregated_from").isNull(), promoted).otherwise(F.col("rationale_note")).alias("rationale_note"))
    sources = mapping_sources(routed).withColumn("promoted", F.lit(False)).unionByName(mapping_sources(up.withColumn("status", F.lit("mapped"))).withColumn("promoted", F.lit(True)))
    flag = up.select(*ROW, F.lit(True).alias("_up"))
    rows = routed.join(flag, ROW, "left").withColumn("status", F.when(F.col("_up"), "auto_mapped").otherwise(F.col("status"))).drop("_up")
    docs = rows.groupBy("document_id").agg(F.count_if(F.col("status") == "auto_mapped").alias("promoted"), F.count_if(F.col("status") == "unmapped").alias("unmapped_count"))
    return {"rows": rows, "values": values, "heads": h, "sources": sources, "balance": balance_identity(values, coa), "outcomes": promoted_outcomes(outcomes(routed), up),
            "documents": docs.withColumn("spread_status", F.when(F.col("unmapped_count") == 0, "spread_complete").otherwise("has_unmapped"))}
