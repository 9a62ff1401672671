"""Corpus analytics: suggestions, threshold what-ifs, score bands, usage and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from .coa import BALANCE_TOLERANCE, _category

ROW = ["document_id", "extraction_id"]


def latest_runs(runs: DataFrame, pdf_only: bool = True, ties: bool = False, id_col: str = "run_id") -> DataFrame:
    """Latest run per filename; with ties=True every run at the latest time."""
    r = runs.filter(F.lower("filename").endswith(".pdf")) if pdf_only else runs
    if ties:
        last = r.groupBy("filename").agg(F.max("created_at").alias("created_at"))
        return r.join(last, ["filename", "created_at"], "left_semi")
    rest = [c for c in r.columns if c != "filename"]
    newest = F.struct("created_at", -F.col(id_col))
    return r.groupBy("filename").agg(F.max_by(F.struct(*rest), newest).alias("r")).select("filename", "r.*").select(*r.columns)


def best_suggestion(suggestions: DataFrame, coa: DataFrame) -> DataFrame:
    """Highest scored suggestion of each row that names a line of the chart; the first one wins a tie."""
    usable = suggestions.filter((F.coalesce("coa_id", F.lit("")) != "") & (F.col("coa_id") != "UNMAPPED")).join(coa.select("coa_id"), "coa_id", "left_semi")
    best = F.struct(F.col("coa_id").alias("best_coa_id"), F.col("score").alias("best_score"))
    return usable.groupBy(*ROW).agg(F.min_by(best, F.struct(-F.coalesce("score", F.lit(0.0)), F.col("cand_rank"))).alias("b")).select(*ROW, "b.*")


def pending_items(routed: DataFrame, row_values: DataFrame, best: DataFrame) -> DataFrame:
    """Rows waiting for a mapping, with their best suggestion and latest value."""
    p = routed.filter("status = 'unmapped'").select(*ROW, "statement_type", "raw_label")
    v = row_values.join(p.select(*ROW), ROW, "left_semi").groupBy(*ROW).agg(
        F.max("year").alias("latest_year"), F.max_by("value", "year").alias("latest_value"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "value"))),
                                 lambda e: F.concat(e["year"], F.lit("="), F.format_string("%.2f", e["value"]))), ", ").alias("values_text"))
    return p.join(v, ROW, "left").join(best, ROW, "left")


def _name(t: float) -> str:
    return f"t{int(round(t * 100)):03d}"


def threshold_coverage(routed: DataFrame, pending: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Per document and threshold: accepted items, coverage and recovered value, in one pass over the items."""
    ts = thresholds or R.SWEEP_THRESHOLDS
    base = routed.groupBy("document_id").agg(F.count_if(F.col("status") == "mapped").alias("_mapped"))

    def ok(t: float) -> Column:
        return F.coalesce(F.col("best_score") >= t, F.lit(False))

    aggs = [F.count(F.lit(1)).alias("_pending")]
    for t in ts:
        aggs += [F.count_if(ok(t)).alias(f"_n_{_name(t)}"), F.sum(F.when(ok(t), F.abs("latest_value"))).alias(f"_v_{_name(t)}")]
    items = pending.groupBy("document_id").agg(*aggs)
    zero = F.lit(0)
    per = F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(f"_n_{_name(t)}", zero).alias("accepted"),
                             F.coalesce(f"_v_{_name(t)}", F.lit(0.0)).alias("value_recovered")) for t in ts])
    out = base.join(items, "document_id", "left").withColumn("_pending", F.coalesce("_pending", zero)).select("document_id", "_mapped", "_pending", F.inline(per))
    total = F.col("_mapped") + F.col("_pending")
    return out.select("document_id", "threshold", (F.col("_mapped") + F.col("accepted")).alias("mapped"), "accepted",
                      (F.col("_pending") - F.col("accepted")).alias("still_unmapped"),
                      F.when(total > 0, F.round((F.col("_mapped") + F.col("accepted")) / total, 6)).alias("coverage"), "value_recovered")


def threshold_balance(signed: DataFrame, pending: DataFrame, row_values: DataFrame, coa: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Balance identity of the latest year per document and threshold, accepted items signed and added.

    Every value carries the score from which on it counts (mapped rows always do); each threshold is a
    conditional sum over the same pass, so values are not multiplied by the number of thresholds.
    """
    ts = thresholds or R.SWEEP_THRESHOLDS
    chart = coa.filter("statement = 'Balance Sheet'").select("coa_id", "broad_category", "sign_convention", (~F.coalesce("is_subtotal", F.lit(False))).alias("_leaf"))
    extra = row_values.select(*ROW, "year", "value").join(
        pending.filter("best_coa_id IS NOT NULL").select(*ROW, F.col("best_coa_id").alias("coa_id"), F.col("best_score").alias("_from")), ROW)
    have = signed.select("document_id", "coa_id", "year", "value").join(chart.drop("sign_convention"), "coa_id").withColumn("_from", F.lit(float("inf")))
    more = extra.join(chart, "coa_id").withColumn("value", X.signed("value", "sign_convention")).select(*have.columns)
    v = have.unionByName(more)

    def part(name: str, t: float) -> Column:
        cond = F.col("_leaf") & F.col("broad_category").isin(_category(name)) & (F.col("_from") >= t)
        return F.coalesce(F.sum(F.when(cond, F.col("value"))), F.lit(0.0))

    aggs = []
    for t in ts:
        aggs += [F.count_if(F.col("_from") >= t).alias(f"_n_{_name(t)}"), part("assets", t).alias(f"_a_{_name(t)}"),
                 (part("liabilities", t) + part("equity", t)).alias(f"_l_{_name(t)}")]
    per = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_n_{_name(t)}").alias("n"), F.col(f"_a_{_name(t)}").alias("total_assets"),
                             F.col(f"_l_{_name(t)}").alias("total_le")) for t in ts])
    y = v.groupBy("document_id", "year").agg(*aggs).select("document_id", "year", F.inline(per)).filter("n > 0")
    h = y.groupBy("document_id", "threshold").agg(F.max_by(F.struct("year", "total_assets", "total_le"), "year").alias("h")).select("document_id", "threshold", "h.*")
    h = h.withColumn("difference", F.round(F.col("total_assets") - F.col("total_le"), 2) + 0.0)
    ok = F.when(F.col("total_assets") != 0, F.abs("difference") / F.abs("total_assets") < BALANCE_TOLERANCE).otherwise(F.abs("difference") < 1e-9)
    return h.withColumn("is_balanced", ok)


def threshold_recon(components: DataFrame, subtotals: DataFrame, rows: DataFrame, outcomes: DataFrame, pending: DataFrame,
                    thresholds: list[float] | None = None) -> DataFrame:
    """Subtotals that still have an unmapped component at each threshold."""
    ts = thresholds or R.SWEEP_THRESHOLDS
    lab = F.lower(F.trim("raw_label")).alias("label")
    key = ["document_id", "label", "statement_type"]
    named = components.join(rows.select("document_id", F.col("extraction_id").alias("component_id"), lab), ["document_id", "component_id"])
    best = pending.groupBy("document_id", lab, "statement_type").agg(F.max("best_score").alias("_best"))
    done = outcomes.filter("status = 'mapped'").select(*key, F.lit(float("inf")).alias("_done"))
    level = F.coalesce("_done", "_best", F.lit(-1.0))
    need = named.join(done, key, "left").join(best, key, "left").groupBy("document_id", "subtotal_id").agg(F.min(level).alias("_min"))
    subs = subtotals.select("document_id", "subtotal_id").join(need, ["document_id", "subtotal_id"], "left")
    per = subs.groupBy("document_id").agg(*[F.count_if(F.col("_min") < t).alias(_name(t)) for t in ts])
    return per.select("document_id", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(_name(t)).alias("with_unmapped_component")) for t in ts])))


def score_bands(pending: DataFrame, bands: int = 5) -> DataFrame:
    """Pending items per document and score band, with a totals row (document_id null)."""
    names = [n for n, _ in (R.SCORE_BANDS if bands == 5 else R.SCORE_BANDS_4)] + ([] if bands == 5 else ["No fit (<0.30)"]) + ["No suggestion"]
    b = pending.withColumn("_band", X.score_band("best_score", bands))
    cols = [F.count_if(F.col("_band") == n).alias("band_" + str(i)) for i, n in enumerate(names, 1)]
    return b.rollup("document_id").agg(*cols, F.count(F.lit(1)).alias("total"))


def flipped_items(pending: DataFrame, low: float = 0.20, high: float = 0.60) -> DataFrame:
    """Items a drop of the threshold from `high` to `low` would map, best first."""
    return pending.filter((F.col("best_score") >= low) & (F.col("best_score") < high)).orderBy(F.desc("best_score"), *ROW)


def unmapped_analysis(pending: DataFrame, documents: DataFrame, coa: DataFrame) -> DataFrame:
    """Report of pending items: line type, band, suggested line, latest value; by report, statement and score."""
    j = pending.join(documents.select("document_id", "filename"), "document_id").join(
        coa.select(F.col("coa_id").alias("best_coa_id"), F.col("line_item_name").alias("coa_name")), "best_coa_id", "left")
    title = X._chain([(F.col("statement_type") == k, v) for k, v in R.STATEMENT_TITLES.items()], F.col("statement_type"))
    return j.select(
        "document_id", "extraction_id", F.regexp_replace("filename", r"\.[^.]*$", "").alias("report"), title.alias("statement"),
        F.col("raw_label").alias("line_item"), X.line_type("raw_label").alias("line_type"), F.coalesce("best_coa_id", F.lit("")).alias("coa_id"),
        F.coalesce("coa_name", F.lit("")).alias("coa_name"), F.col("best_score").alias("score"), X.score_band("best_score", 4).alias("band"),
        F.col("latest_value").alias("value"), "values_text").orderBy("report", "statement", F.desc(F.coalesce("score", F.lit(0.0))), "extraction_id")


def unmapped_counts(analysis: DataFrame) -> DataFrame:
    """Pending items by line type and by statement."""
    n = F.count(F.lit(1)).alias("n")
    return analysis.groupingSets([[F.col("line_type")], [F.col("statement")]], "line_type", "statement").agg(n)


def unify_usage(events: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """One record layout for usage; missing counts are 0. `other` names its tokens prompt_tokens and completion_tokens."""
    def tidy(df: DataFrame, names: dict[str, str]) -> DataFrame:
        have = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) if c in df.columns else F.lit(0).cast("bigint")
        return df.select("document_id", "ts", F.coalesce("stage", F.lit("other")).alias("stage"), X.model_id("model").alias("model"),
                         *[have(src).alias(dst) for dst, src in names.items()])

    same = {c: c for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation")}
    out = tidy(events, same)
    if other is not None:
        out = out.unionByName(tidy(other, {**same, "input_tokens": "prompt_tokens", "output_tokens": "completion_tokens"}))
    return out


TOKENS = ["input_tokens", "output_tokens", "cache_read", "cache_creation"]


def usage_by_model(usage: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, calls and list-price cost per `by`, stage and model; unpriced models cost 0 and are flagged."""
    g = usage.groupBy(*by, "stage", "model").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in TOKENS])
    cost = X.call_cost("model", "input_tokens", "output_tokens", "cache_read", "cache_creation")
    return g.withColumns({"cost_usd": F.coalesce(cost, F.lit(0.0)), "unknown_pricing": cost.isNull()})


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Usage per stage with a total row (stage null)."""
    return usage_by_model(usage, []).rollup("stage").agg(
        *[F.sum(c).alias(c) for c in ["calls", *TOKENS]], F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.max("unknown_pricing").alias("unknown_pricing"))


def usage_per_document(usage: DataFrame) -> DataFrame:
    u = usage_by_model(usage, ["document_id"])
    stage = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("cost_usd"))), F.lit(0.0))
    return u.groupBy("document_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
                                        stage("extraction").alias("extraction_cost"), stage("spreading").alias("spreading_cost"),
                                        F.sum("cost_usd").alias("total_cost"))


def usage_kpis(per_document: DataFrame, page_summary: DataFrame) -> DataFrame:
    """Corpus figures: tokens, cost, average per report, cost by stage and by document type."""
    d = per_document.join(page_summary.select("document_id", "digital", "scanned"), "document_id", "left")
    kind = F.coalesce("scanned", F.lit(0)) > F.coalesce("digital", F.lit(0))
    r = lambda c: F.round(c, 6)
    return d.agg(F.count(F.lit(1)).alias("doc_count"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
                 r(F.sum("total_cost")).alias("total_cost"), r(F.avg("total_cost")).alias("avg_per_report"),
                 r(F.sum("extraction_cost")).alias("extraction_cost"), r(F.sum("spreading_cost")).alias("spreading_cost"),
                 F.count_if(kind).alias("scanned_docs"), r(F.coalesce(F.avg(F.when(kind, F.col("total_cost"))), F.lit(0.0))).alias("scanned_avg"),
                 r(F.coalesce(F.avg(F.when(~kind, F.col("total_cost"))), F.lit(0.0))).alias("digital_avg"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
