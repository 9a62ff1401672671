"""Registered analytics, view and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from ..operators import analytics as N
from ..operators import coa as A
from ..operators import pages as P
from ..operators import reconcile as Q
from ..operators import rows as W
from ..operators import views as V
from ..operators.ordered import in_documents
from ..sources import sinks
from .catalog import query
from .queries_canonical import CAN, CHECKS, SC, checks, engine_rows, scored
from .queries_coa import AG, BAL, COA, CROSSFOOT, KEYED, RT, SG, aggregated, balance, crossfooted, grouped, routed, signed
from .queries_pages import CLS, NORM, PAGES, SEC, classified, sectioned
from .queries_rows import NOTED, NOTE_PAGES, ROWS, SCOPED, noted_rows, scoped_rows

SUG = (*COA, "fx_suggestions")
BEST = """SELECT document_id, extraction_id, arg_min(coa_id, (-score, cand_rank)) AS best_coa_id, max(score) AS best_score FROM fx_suggestions GROUP BY ALL"""
PENDING = """SELECT r.document_id, r.extraction_id, r.statement_type, r.raw_label, b.best_coa_id, b.best_score, v.latest_year, v.latest_value, v.values_text FROM routed r
LEFT JOIN best b USING (document_id, extraction_id)
LEFT JOIN (SELECT document_id, extraction_id, max(year) AS latest_year, arg_max(value, year) AS latest_value,
  string_agg(year || '=' || printf('%.2f', value), ', ' ORDER BY year) AS values_text FROM fx_row_values GROUP BY ALL) v USING (document_id, extraction_id)
WHERE r.status = 'unmapped'"""
PE = {**RT, "best": BEST, "pend": PENDING}


def best(t):
    return N.best_suggestion(t.suggestions, t.coa)


def pending(t):
    return t.stage("pending", lambda: N.pending_items(routed(t), t.row_values, best(t)))


@query("f01_latest_runs", """SELECT filename, run_id, created_at, run_status FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_at DESC, run_id) AS rn
FROM fx_runs WHERE lower(filename) LIKE '%.pdf') t WHERE rn = 1""", ("fx_runs",))
def f01(t):
    return N.latest_runs(t.runs).select("filename", "run_id", "created_at", "run_status")


@query("f01_latest_runs_with_ties", """SELECT filename, run_id, created_at FROM (SELECT *, rank() OVER (PARTITION BY filename ORDER BY created_at DESC) AS rn FROM fx_runs) t WHERE rn = 1""", ("fx_runs",))
def f01b(t):
    return N.latest_runs(t.runs, pdf_only=False, ties=True).select("filename", "run_id", "created_at")


@query("f02_best_suggestion", "SELECT document_id, extraction_id, best_coa_id, best_score FROM best", SUG, {"best": BEST})
def f02(t):
    return best(t)


_TS = ", ".join(f"({x})" for x in R.SWEEP_THRESHOLDS)


@query("f03_threshold_coverage", f"""SELECT m.document_id, CAST(t.t AS DOUBLE) AS threshold, m.mapped + coalesce(n, 0) AS mapped, coalesce(n, 0) AS accepted, p.all_pending - coalesce(n, 0) AS still_unmapped,
  CASE WHEN m.mapped + p.all_pending > 0 THEN round((m.mapped + coalesce(n, 0)) / CAST(m.mapped + p.all_pending AS DOUBLE), 6) END AS coverage, round(coalesce(v, 0), 2) AS value_recovered
FROM (SELECT document_id, count(*) FILTER (status = 'mapped') AS mapped FROM routed GROUP BY 1) m CROSS JOIN (VALUES {_TS}) t(t)
LEFT JOIN (SELECT document_id, t.t, count(*) AS n, sum(abs(latest_value)) AS v FROM pend JOIN (VALUES {_TS}) t(t) ON best_score >= t.t GROUP BY ALL) a ON a.document_id = m.document_id AND a.t = t.t
JOIN (SELECT document_id, count(*) FILTER (status = 'unmapped') AS all_pending FROM routed GROUP BY 1) p ON p.document_id = m.document_id""", SUG, PE)
def f03(t):
    return N.threshold_coverage(routed(t), pending(t)).withColumn("value_recovered", F.round("value_recovered", 2))


SWEEP = f"""SELECT document_id, threshold, year, round(a, 2) + 0.0 AS total_assets, round(le, 2) + 0.0 AS total_le, round(a - le, 2) + 0.0 AS difference,
  CASE WHEN a <> 0 THEN abs(round(a - le, 2)) / abs(a) < 0.001 ELSE abs(round(a - le, 2)) < 1e-9 END AS is_balanced FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, threshold ORDER BY year DESC) AS rn FROM (
    SELECT x.document_id, CAST(t.t AS DOUBLE) AS threshold, x.year, coalesce(sum(x.value) FILTER (NOT c.is_subtotal AND c.broad_category IN ('Current Assets', 'Non-Current Assets')), 0) AS a,
      coalesce(sum(x.value) FILTER (NOT c.is_subtotal AND c.broad_category NOT IN ('Current Assets', 'Non-Current Assets')), 0) AS le
    FROM (VALUES {_TS}) t(t) JOIN (
      SELECT document_id, coa_id, year, value, 9.0 AS s FROM signed
      UNION ALL SELECT v.document_id, p.best_coa_id, v.year, CASE WHEN c.sign_convention = 'contra' THEN -abs(v.value) ELSE v.value END, p.best_score
      FROM pend p JOIN fx_row_values v USING (document_id, extraction_id) JOIN fx_coa c ON c.coa_id = p.best_coa_id) x ON x.s >= t.t
    JOIN fx_coa c ON c.coa_id = x.coa_id AND c.statement = 'Balance Sheet' GROUP BY ALL) g) h WHERE rn = 1"""


@query("f03_threshold_balance", SWEEP, SUG, {**SG, "best": BEST, "pend": PENDING})
def f03b(t):
    return N.threshold_balance(signed(t), pending(t), t.row_values, t.coa).withColumns({c: F.round(c, 2) + 0.0 for c in ("total_assets", "total_le")})


@query("f03_threshold_recon", f"""SELECT s.document_id, CAST(t.t AS DOUBLE) AS threshold, count(*) FILTER (n.least < t.t) AS with_unmapped_component FROM sb s CROSS JOIN (VALUES {_TS}) t(t)
LEFT JOIN (SELECT c.document_id, c.subtotal_id, min(CASE WHEN o.status = 'mapped' THEN 'inf'::DOUBLE ELSE coalesce(b.best, -1.0) END) AS least FROM states c
  LEFT JOIN outc o ON o.document_id = c.document_id AND o.label = lower(trim(c.raw_label)) AND o.statement_type = c.statement_type
  LEFT JOIN (SELECT document_id, lower(trim(raw_label)) AS label, statement_type, max(best_score) AS best FROM pend GROUP BY ALL) b ON b.document_id = c.document_id AND b.label = lower(trim(c.raw_label)) AND b.statement_type = c.statement_type
  GROUP BY ALL) n ON n.document_id = s.document_id AND n.subtotal_id = s.id GROUP BY ALL""", SUG, {**CROSSFOOT, **PE})
def f03c(t):
    comps, subs = grouped(t)
    return N.threshold_recon(comps, subs, t.rows, A.outcomes(routed(t)), pending(t))


def _bands(table, last):
    names = [(f"best_score >= {lo}", n) for n, lo in table]
    case = "CASE WHEN best_score IS NULL THEN 'No suggestion' " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in names) + f" ELSE '{last}' END"
    cols = [n for n, _ in table] + ([] if last in [n for n, _ in table] else [last]) + ["No suggestion"]
    return "SELECT document_id, " + ", ".join(f"count(*) FILTER (({case}) = '{n}') AS band_{i}" for i, n in enumerate(cols, 1)) + ", count(*) AS total FROM pend GROUP BY ROLLUP (document_id)"


@query("f04_score_bands", _bands(R.SCORE_BANDS, "No fit (0.00-0.19)"), SUG, PE)
def f04(t):
    return N.score_bands(pending(t))


@query("f04_score_bands_short", _bands(R.SCORE_BANDS_4, "No fit (<0.30)"), SUG, PE)
def f04b(t):
    return N.score_bands(pending(t), 4)


@query("f05_flipped_items", "SELECT document_id, extraction_id, raw_label, best_coa_id, best_score FROM pend WHERE best_score >= 0.20 AND best_score < 0.60", SUG, PE)
def f05(t):
    return N.flipped_items(pending(t)).select("document_id", "extraction_id", "raw_label", "best_coa_id", "best_score")


LINE = f"CASE WHEN regexp_matches(raw_label, '{R.TOTAL_LINE}') THEN 'Total' WHEN regexp_matches(raw_label, '{R.SUBTOTAL_LINE}') THEN 'Sub-total' ELSE 'Main line item' END"
ANALYSIS = f"""SELECT p.document_id, p.extraction_id, regexp_replace(d.filename, '\\.[^.]*$', '') AS report,
  CASE p.statement_type WHEN 'balance_sheet' THEN 'Balance Sheet' ELSE 'Income Statement' END AS statement, raw_label AS line_item, {LINE} AS line_type,
  coalesce(best_coa_id, '') AS coa_id, coalesce(c.line_item_name, '') AS coa_name, best_score AS score,
  CASE WHEN best_score IS NULL THEN 'No suggestion' WHEN best_score >= 0.55 THEN 'Near-miss (0.55-0.59)' WHEN best_score >= 0.45 THEN 'Low (0.45-0.54)'
    WHEN best_score >= 0.30 THEN 'Very low (0.30-0.44)' ELSE 'No fit (<0.30)' END AS band, latest_value AS value, values_text
FROM pend p JOIN fx_documents d USING (document_id) LEFT JOIN fx_coa c ON c.coa_id = p.best_coa_id"""
AN = {**PE, "an": ANALYSIS}


def analysis(t):
    return N.unmapped_analysis(pending(t), t.documents, t.coa)


@query("f06_unmapped_analysis", "SELECT * FROM an", (*SUG, "fx_documents"), AN)
def f06(t):
    return analysis(t)


@query("f07_unmapped_counts", "SELECT line_type, statement, count(*) AS n FROM an GROUP BY GROUPING SETS ((line_type), (statement))", (*SUG, "fx_documents"), AN)
def f07(t):
    return N.unmapped_counts(analysis(t))


_FLAT = """SELECT s.document_id, s.statement_type, s.subtotal_id, NULL::INT AS component_id, s.raw_label AS line_item, NULL::VARCHAR AS status, NULL::VARCHAR AS coa_id, NULL::VARCHAR AS coa_name, NULL::DOUBLE AS confidence,
  y.extracted AS value, round(coalesce(y.total, NULL), 2) AS computed, round(y.difference, 2) + 0.0 AS difference, CASE WHEN s.passed THEN 'PASS' WHEN NOT s.passed THEN 'FAIL' ELSE 'INCOMPLETE' END AS result, s.method,
  coalesce(m.n, 0) AS n_missing, CASE WHEN coalesce(m.n, 0) > 0 THEN 'unmapped component' ELSE '' END AS flags
FROM report s LEFT JOIN years y ON y.document_id = s.document_id AND y.subtotal_id = s.subtotal_id AND y.year = s.headline
LEFT JOIN (SELECT document_id, subtotal_id, count(*) FILTER (status <> 'mapped') AS n FROM states GROUP BY ALL) m ON m.document_id = s.document_id AND m.subtotal_id = s.subtotal_id
UNION ALL SELECT c.document_id, c.statement_type, c.subtotal_id, c.component_id, c.raw_label, c.status, o.coa_id, k.line_item_name, o.confidence, v.value, NULL, NULL, NULL, NULL, NULL, CASE WHEN f.flipped THEN 'SIGN FLIP' ELSE '' END
FROM states c JOIN report s ON s.document_id = c.document_id AND s.subtotal_id = c.subtotal_id
LEFT JOIN (SELECT document_id, lower(trim(raw_label)) AS label, statement_type, arg_max_null(coa_id, extraction_id) AS coa_id, arg_max_null(confidence, extraction_id) AS confidence FROM routed WHERE status <> 'skipped' GROUP BY ALL) o
  ON o.document_id = c.document_id AND o.label = lower(trim(c.raw_label)) AND o.statement_type = c.statement_type
LEFT JOIN fx_coa k ON k.coa_id = o.coa_id LEFT JOIN rv v ON v.document_id = c.document_id AND v.id = c.component_id AND v.year = s.headline
LEFT JOIN (SELECT document_id, extraction_id, bool_or(raw_value <> 0 AND (raw_value < 0) <> (value < 0)) AS flipped FROM signed GROUP BY ALL) f ON f.document_id = c.document_id AND f.extraction_id = c.component_id"""


@query("f08_recon_flat", _FLAT, COA, {**SG, **{k: v for k, v in CROSSFOOT.items() if k != "routed"}})
def f08(t):
    years, report = crossfooted(t)
    flat = Q.recon_flat(grouped(t)[0], report, years, t.rows, t.row_values, A.outcomes(routed(t)), t.coa, Q.sign_flip(t.row_values, signed(t)), t.stored)
    return flat.withColumns({"computed": F.round("computed", 2), "difference": F.round("difference", 2) + 0.0})


USED = "SELECT *, regexp_replace(model, '^.*\\.', '') AS m FROM fx_usage"


def _cost_sql(by: str) -> str:
    rate = lambda k: "CASE m " + " ".join(f"WHEN '{n}' THEN {v[k]}" for n, v in R.MODEL_PRICING.items()) + " END"
    return f"""SELECT {by} stage, m, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS it, CAST(sum(output_tokens) AS BIGINT) AS ot, CAST(sum(cache_read) AS BIGINT) AS cr, CAST(sum(cache_creation) AS BIGINT) AS cw,
  coalesce(round(sum(input_tokens) / 1e6 * {rate(0)} + sum(output_tokens) / 1e6 * {rate(1)} + sum(cache_read) / 1e6 * {rate(0)} * 0.1 + sum(cache_creation) / 1e6 * {rate(0)} * 1.25, 6), 0.0) AS cost,
  {rate(0)} IS NULL AS unk FROM used GROUP BY {by} stage, m"""


def usage(t):
    return N.unify_usage(t.usage)


@query("f10_usage_rollup", """SELECT stage, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(it) AS BIGINT) AS input_tokens, CAST(sum(ot) AS BIGINT) AS output_tokens, CAST(sum(cr) AS BIGINT) AS cache_read,
  CAST(sum(cw) AS BIGINT) AS cache_creation, round(sum(cost), 6) AS cost_usd, bool_or(unk) AS unknown_pricing FROM uc GROUP BY ROLLUP (stage)""", ("fx_usage",), {"used": USED, "uc": _cost_sql("")})
def f10(t):
    return N.usage_rollup(usage(t))


@query("f10_usage_two_layouts", """SELECT stage, count(*) AS calls, CAST(sum(it) AS BIGINT) AS input_tokens FROM (
  SELECT stage, input_tokens AS it FROM fx_usage UNION ALL SELECT stage, input_tokens FROM fx_usage WHERE event_id % 2 = 0) t GROUP BY ROLLUP (stage)""", ("fx_usage",))
def f10b(t):
    other = t.usage.filter("event_id % 2 = 0").select("document_id", "ts", "stage", "model", F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"))
    return N.usage_rollup(N.unify_usage(t.usage, other)).select("stage", "calls", "input_tokens")


@query("f11_usage_kpis", """SELECT count(*) AS doc_count, CAST(sum(it) AS BIGINT) AS input_tokens, CAST(sum(ot) AS BIGINT) AS output_tokens, round(sum(c), 6) AS total_cost, round(avg(c), 6) AS avg_per_report,
  round(sum(ec), 6) AS extraction_cost, round(sum(sc), 6) AS spreading_cost, count(*) FILTER (k) AS scanned_docs, round(coalesce(avg(c) FILTER (k), 0), 6) AS scanned_avg, round(coalesce(avg(c) FILTER (NOT k), 0), 6) AS digital_avg
FROM (SELECT u.*, coalesce(scanned, 0) > coalesce(digital, 0) AS k FROM (SELECT document_id, sum(it) AS it, sum(ot) AS ot, sum(cost) AS c, coalesce(sum(cost) FILTER (stage = 'extraction'), 0) AS ec,
    coalesce(sum(cost) FILTER (stage = 'spreading'), 0) AS sc FROM uc GROUP BY document_id) u
  LEFT JOIN (SELECT document_id, count(*) FILTER (cls = 'digital') AS digital, count(*) FILTER (cls = 'scanned') AS scanned FROM o_class GROUP BY 1) p USING (document_id)) t""",
       ("fx_usage", "fx_pages"), {**CLS, "used": USED, "uc": _cost_sql("document_id,")})
def f11(t):
    return N.usage_kpis(N.usage_per_document(usage(t)), P.page_summary(classified(t)))


@query("f12_document_library", """SELECT d.document_id, d.filename, coalesce(mapped_rows, 0) AS mapped_rows, coalesce(mappable_rows, 0) AS mappable_rows, coalesce(low_conf, 0) + coalesce(unm, 0) AS flagged,
  round(CASE WHEN balanced THEN 0.5 ELSE 0 END + 0.5 * CASE WHEN mappable_rows > 0 THEN mapped_rows / CAST(mappable_rows AS DOUBLE) ELSE 0 END, 6) AS health, n.run_status,
  CASE WHEN n.run_status IN ('error', 'processing') THEN n.run_status WHEN n.run_status <> 'done' THEN 'queued' WHEN unm > 0 THEN 'has_unmapped' ELSE 'complete' END AS ui_status, round(u.cost, 6) AS cost_usd
FROM (SELECT document_id, concat('filing_', document_id, '_', fiscal_year, '.pdf') AS filename FROM fx_documents) d LEFT JOIN (SELECT document_id, count(*) FILTER (status = 'mapped') AS mapped_rows, count(*) FILTER (status = 'unmapped') AS unm,
    count(*) FILTER (statement_type IN ('balance_sheet', 'income_statement')) AS mappable_rows FROM routed GROUP BY 1) r USING (document_id)
LEFT JOIN (SELECT document_id, count(*) FILTER (c < 0.75) AS low_conf FROM (SELECT document_id, coa_id, arg_min(confidence, extraction_id) AS c FROM routed WHERE status = 'mapped' GROUP BY ALL) GROUP BY 1) h USING (document_id)
LEFT JOIN (SELECT document_id, is_balanced AS balanced FROM bal WHERE headline) b USING (document_id)
LEFT JOIN (SELECT filename, run_status FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_at DESC, run_id) AS rn FROM fx_runs WHERE lower(filename) LIKE '%.pdf') WHERE rn = 1) n ON n.filename = d.filename
LEFT JOIN (SELECT document_id, sum(cost) AS cost FROM uc GROUP BY 1) u USING (document_id)""", (*COA, "fx_documents", "fx_runs", "fx_usage"), {**BAL, "used": USED, "uc": _cost_sql("document_id,")})
def f12(t):
    docs = t.documents.withColumn("filename", F.concat(F.lit("filing_"), F.col("document_id").cast("string"), F.lit("_"), F.col("fiscal_year").cast("string"), F.lit(".pdf")))
    cost = N.usage_per_document(usage(t)).withColumnRenamed("total_cost", "cost_usd")
    out = V.document_library(docs, t.rows, routed(t), A.mapping_heads(routed(t)), balance(t), N.latest_runs(t.runs), cost)
    return out.select("document_id", "filename", "mapped_rows", "mappable_rows", "flagged", F.col("health").cast("double").alias("health"), "run_status", "ui_status", F.round("cost_usd", 6).alias("cost_usd"))


@query("f12_ui_status", """SELECT run_id, CASE WHEN run_status IN ('error', 'processing') THEN run_status WHEN run_status <> 'done' THEN 'queued' WHEN run_id % 2 = 0 THEN 'complete' ELSE 'has_unmapped' END AS ui_status FROM fx_runs""", ("fx_runs",))
def f12b(t):
    r = t.runs.withColumn("spread_status", F.when(F.col("run_id") % 2 == 0, "spread_complete").otherwise("has_unmapped"))
    return r.select("run_id", V.ui_status().alias("ui_status"))


@query("f13_list_documents", "SELECT document_id, filename, fiscal_year FROM fx_documents WHERE template_type = 'T3' ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 20", ("fx_documents",))
def f13(t):
    return V.list_documents(t.documents, {"template_type": "T3"}, page=2)[0].select("document_id", "filename", "fiscal_year")


@query("f13_list_total", "SELECT count(*) AS total FROM fx_documents WHERE template_type = 'T3'", ("fx_documents",))
def f13b(t):
    return V.list_documents(t.documents, {"template_type": "T3"})[1]


@query("f14_document_counts", """SELECT d.document_id, coalesce(e, 0) AS extracted, coalesce(m, 0) AS mapped, coalesce(r, 0) AS needs_review FROM fx_documents d
LEFT JOIN (SELECT document_id, count(*) AS e FROM fx_rows GROUP BY 1) a USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS m, count(*) FILTER (review_status = 'needs_review') AS r FROM sc GROUP BY 1) b USING (document_id)""", ("fx_documents", "fx_rows", "fx_canonical"), SC)
def f14(t):
    return V.document_counts(t.documents, t.rows, scored(t))


@query("f15_run_status", """SELECT run_id, run_status, error_message, CASE WHEN run_status = 'done' THEN coalesce(n, 0) END AS n_rows FROM fx_runs
LEFT JOIN (SELECT l_orderkey AS run_id, count(*) AS n FROM lineitem GROUP BY 1) c USING (run_id)""", ("fx_runs",))
def f15(t):
    n = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return V.run_status(t.runs, n, "run_id").select("run_id", "run_status", "error_message", "n_rows")


FY = """SELECT document_id, {k}, max(CASE WHEN rn = 1 THEN value END) AS fy1, max(CASE WHEN rn = 2 THEN value END) AS fy2 FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, {k} ORDER BY CAST(year AS INT) DESC) AS rn FROM {t}) x GROUP BY ALL"""


_NODES = f"""SELECT n.document_id, c.statement, c.broad_category AS category, n.coa_id, NULL::INT AS leaf_id, NULL::VARCHAR AS leaf_label, round(f.fy1, 2) AS fy1, round(f.fy2, 2) AS fy2, n.confidence,
  k.passed AS reconciles, k.has_unmapped AS missing_leaf, NULL::INT AS page, NULL::VARCHAR AS note_ref
FROM (SELECT document_id, coa_id, arg_min(confidence, extraction_id) AS confidence, string_agg(nullif({KEYED.format('raw_label')}, ''), ' ' ORDER BY extraction_id) AS key FROM routed WHERE status = 'mapped' GROUP BY ALL) n JOIN fx_coa c USING (coa_id)
LEFT JOIN ({FY.format(k='coa_id', t='agg')}) f ON f.document_id = n.document_id AND f.coa_id = n.coa_id
LEFT JOIN (SELECT document_id, {KEYED.format('raw_label')} AS key, arg_max_null(passed, subtotal_id) AS passed, arg_max_null(has_unmapped, subtotal_id) AS has_unmapped FROM report GROUP BY ALL) k ON k.document_id = n.document_id AND k.key = n.key"""
_TREE = f"""{_NODES}
UNION ALL SELECT r.document_id, c.statement, c.broad_category, r.coa_id, r.extraction_id, r.raw_label, round(f.fy1, 2), round(f.fy2, 2), NULL, NULL, NULL, r.section_no + 1, CASE WHEN NOT r.is_subtotal THEN 'Note ' || r.section_no END FROM routed r JOIN fx_coa c USING (coa_id)
LEFT JOIN ({FY.format(k='extraction_id', t='fx_row_values')}) f ON f.document_id = r.document_id AND f.extraction_id = r.extraction_id WHERE r.status = 'mapped'"""


def tree(t):
    note = F.when(~F.col("is_subtotal"), F.concat(F.lit("Note "), F.col("section_no").cast("string")))
    src = routed(t).filter("status = 'mapped'").select("document_id", "coa_id", "extraction_id", "raw_label", (F.col("section_no") + 1).cast("int").alias("page"), note.alias("note_ref"))
    return V.spread_tree(A.mapping_heads(routed(t)), aggregated(t), t.coa, src, t.row_values, crossfooted(t)[1])


@query("f16_spread_tree", "SELECT * FROM tree", COA, {**AG, **{k: v for k, v in CROSSFOOT.items() if k != "routed"}, "tree": _TREE})
def f16(t):
    return tree(t).select("document_id", "statement", "category", "coa_id", "leaf_id", "leaf_label", F.round("fy1", 2).alias("fy1"), F.round("fy2", 2).alias("fy2"), "confidence", "reconciles", "missing_leaf", "page", "note_ref")


@query("f16_tree_sections", """SELECT document_id, statement, category, count(*) FILTER (leaf_id IS NULL) AS n_lines, count(leaf_id) AS n_leaves, round(sum(fy1) FILTER (leaf_id IS NULL), 2) AS fy1,
  count(*) FILTER (reconciles) AS n_reconciled, count(*) FILTER (NOT reconciles) AS n_failed, count(*) FILTER (missing_leaf) AS n_missing_leaf FROM tree GROUP BY ALL""", COA, {**AG, **{k: v for k, v in CROSSFOOT.items() if k != "routed"}, "tree": _TREE})
def f16b(t):
    return V.tree_sections(tree(t)).select("document_id", "statement", "category", "n_lines", "n_leaves", F.round("fy1", 2).alias("fy1"), "n_reconciled", "n_failed", "n_missing_leaf")


@query("f17_fy12", FY.format(k="extraction_id", t="fx_row_values"), ("fx_row_values",))
def f17(t):
    return V.fy12(t.row_values, ["document_id", "extraction_id"])


@query("f18_workbench_rows", """SELECT r.document_id, r.extraction_id, r.raw_label, m.coa_id, c.line_item_name AS coa_name FROM fx_rows r
LEFT JOIN (SELECT document_id, extraction_id, coa_id FROM routed WHERE status = 'mapped') m USING (document_id, extraction_id) LEFT JOIN fx_coa c ON c.coa_id = m.coa_id""", COA, RT)
def f18(t):
    m = A.mapping_sources(routed(t)).withColumn("mapping_id", F.concat_ws("/", "document_id", "coa_id"))
    return V.workbench_rows(t.rows, m, t.coa).select("document_id", "extraction_id", "raw_label", "coa_id", "coa_name")


@query("f19_rows_by_document", "SELECT document_id, extraction_id, raw_label FROM fx_rows WHERE statement_type = 'cash_flow'", ROWS)
def f19(t):
    return V.rows_by_document(t.rows, statement_type="cash_flow").select("document_id", "extraction_id", "raw_label")


@query("f19_rows_of_all_statements", "SELECT document_id, extraction_id, statement_type, raw_label FROM fx_rows", ROWS)
def f19b(t):
    return V.rows_by_document(t.rows).select("document_id", "extraction_id", "statement_type", "raw_label")


@query("f20_mapped_rows_view", """SELECT s.document_id, s.rn AS extraction_id, s.raw_field, r.raw_label, s.score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY raw_field) AS INT) AS rn FROM sc) s
LEFT JOIN fx_rows r ON r.document_id = s.document_id AND r.extraction_id = s.rn WHERE s.review_status = 'needs_review' AND s.score < 0.9""", (*CAN, "fx_rows"), SC)
def f20(t):
    m = numbered_scored(t)
    return V.mapped_rows_view(m, t.rows.select("document_id", "extraction_id", "raw_label"), "needs_review", 0.9).select("document_id", "extraction_id", "raw_field", "raw_label", "score")


def numbered_scored(t):
    """Mapped rows with a row number; a filing has at most one row per canonical field."""
    from pyspark.sql import Window
    w = Window.partitionBy("document_id").orderBy("raw_field")
    return scored(t).withColumn("extraction_id", F.row_number().over(w))


@query("f21_unmapped_view", """SELECT r.document_id, r.extraction_id, r.status, r.raw_label, CAST(s.rn AS INT) AS suggestion_no, s.coa_id, s.coa_name, s.score FROM routed r
LEFT JOIN (SELECT x.*, c.line_item_name AS coa_name, row_number() OVER (PARTITION BY document_id, extraction_id ORDER BY score DESC, cand_rank) AS rn FROM fx_suggestions x JOIN fx_coa c USING (coa_id)) s
  ON s.document_id = r.document_id AND s.extraction_id = r.extraction_id AND s.rn <= 3 WHERE r.status IN ('unmapped', 'not_spread')""", SUG, RT)
def f21(t):
    return V.unmapped_view(routed(t), t.suggestions, t.coa).select("document_id", "extraction_id", "status", "raw_label", "suggestion_no", "coa_id", "coa_name", "score")


@query("f21_unmapped_detail", """SELECT r.document_id, r.extraction_id, r.raw_label, r.section_no + 1 AS page, CAST(s.rn AS INT) AS suggestion_no, s.coa_id, s.coa_name, s.definition, s.score FROM routed r
LEFT JOIN (SELECT x.*, c.line_item_name AS coa_name, 'Lines named ' || c.line_item_name AS definition, row_number() OVER (PARTITION BY document_id, extraction_id ORDER BY score DESC, cand_rank) AS rn FROM fx_suggestions x JOIN fx_coa c USING (coa_id)) s
  ON s.document_id = r.document_id AND s.extraction_id = r.extraction_id AND s.rn <= 3 WHERE r.status = 'unmapped'""", SUG, RT)
def f21b(t):
    coa = t.coa.withColumn("definition", F.concat(F.lit("Lines named "), F.col("line_item_name")))
    pages = t.rows.select("document_id", "extraction_id", (F.col("section_no") + 1).cast("int").alias("page"))
    return V.unmapped_view(routed(t), t.suggestions, coa, pending_only=True, pages=pages).select("document_id", "extraction_id", "raw_label", "page", "suggestion_no", "coa_id", "coa_name", "definition", "score")


_QUEUE = """SELECT r.document_id, r.extraction_id, r.status, s.suggestions, CASE WHEN r.status = 'unmapped' THEN
    concat_ws('; ', CASE WHEN r.extraction_id % 2 = 0 THEN 'short label' END, CASE WHEN r.section_no > 2 THEN 'several sections fit' END) ELSE '{note}' END AS ambiguity_note
FROM routed r LEFT JOIN (SELECT document_id, extraction_id, string_agg(coa_id || '=' || printf('%.2f', score), ' ' ORDER BY cand_rank) AS suggestions FROM fx_suggestions GROUP BY ALL) s
  ON r.status = 'unmapped' AND s.document_id = r.document_id AND s.extraction_id = r.extraction_id WHERE r.status IN ('unmapped', 'not_spread')"""


@query("e08_queue", _QUEUE.format(note=R.EQUITY_NOTE.replace("'", "''")), SUG, RT)
def e08b(t):
    """Queued rows with all their suggestions and the ambiguities of their answers."""
    notes = t.rows.select("document_id", "extraction_id", F.array_compact(F.array(F.when(F.col("extraction_id") % 2 == 0, "short label"), F.when(F.col("section_no") > 2, "several sections fit"))).alias("ambiguities"))
    q = A.queue_items(routed(t), t.suggestions, notes)
    listed = F.array_join(F.transform("suggestions", lambda s: F.concat(s["coa_id"], F.lit("="), F.format_string("%.2f", s["score"]))), " ")
    return q.select("document_id", "extraction_id", "status", F.when(F.size("suggestions") > 0, listed).alias("suggestions"), "ambiguity_note")


HEADS = """SELECT document_id, coa_id, arg_min(confidence, extraction_id) AS confidence, arg_min(raw_label, extraction_id) AS raw_label FROM routed WHERE status = 'mapped' GROUP BY ALL"""


@query("f22_confidence_rows", "SELECT h.document_id, h.coa_id, h.confidence, c.line_item_name, c.statement FROM h JOIN fx_coa c USING (coa_id)", COA, {**RT, "h": HEADS})
def f22(t):
    return V.confidence_rows(A.mapping_heads(routed(t)), t.coa).select("document_id", "coa_id", "confidence", "line_item_name", "statement")


def learned_routed(t):
    from .queries_coa import learned_hits
    return A.route(t.rows, t.answers, learned_hits(t).select("document_id", "extraction_id", "coa_id", "confidence", "learned_id"))


from .queries_coa import LE, LH  # noqa: E402


@query("f23_learned_applied", """SELECT h.document_id, h.extraction_id, h.learned_id, h.coa_id, l.source_document FROM lhits h JOIN fx_learned l USING (learned_id)""", LE, LH)
def f23(t):
    return V.learned_applied(learned_routed(t), t.learned).select("document_id", "extraction_id", "learned_id", "coa_id", "source_document")


@query("f24_learned_list", "SELECT learned_id, label_key, coa_id FROM fx_learned WHERE template_type = '*' AND statement_type = 'balance_sheet' AND learned_id % 5 <> 0", ("fx_learned",))
def f24(t):
    return V.learned_list(t.learned, "*", "balance_sheet", t.learned.filter("learned_id % 5 = 0")).select("learned_id", "label_key", "coa_id")


@query("f24_learned_list_whole", "SELECT learned_id, template_type, statement_type, label_key, coa_id FROM fx_learned", ("fx_learned",))
def f24b(t):
    return V.learned_list(t.learned).select("learned_id", "template_type", "statement_type", "label_key", "coa_id")


NOTES = {**SEC, "np": NOTE_PAGES}


@query("f25_notes_view", "SELECT document_id, note_number, count(*) AS n_pages FROM np WHERE note_number = 1 GROUP BY ALL", PAGES, NOTES)
def f25(t):
    n = P.note_pages(sectioned(t)).groupBy("document_id", "note_number").agg(F.count(F.lit(1)).alias("n_pages"))
    return V.notes_view(n, note_number=1)


@query("f25_notes_view_whole", "SELECT document_id, note_number, count(*) AS n_pages FROM np GROUP BY ALL", PAGES, NOTES)
def f25b(t):
    return V.notes_view(P.note_pages(sectioned(t)).groupBy("document_id", "note_number").agg(F.count(F.lit(1)).alias("n_pages")))


@query("f26_override_history", """SELECT event_id AS decision_id, user_id AS document_id FROM events WHERE event_type IN ('purchase', 'view') AND event_id % 3 <> 2
AND user_id IN (SELECT document_id FROM fx_documents WHERE template_type = 'T1')""", ("fx_documents",))
def f26(t):
    from .queries_canonical import review_decisions
    audit = review_decisions(t).filter("new_field IS NOT NULL OR new_value IS NOT NULL")
    wanted = t.documents.filter("template_type = 'T1'").select(F.concat(F.col("document_id").cast("string"), F.lit("/total_assets")).alias("row_id"))
    return V.override_history(audit, wanted).select("decision_id", F.split("row_id", "/")[0].cast("bigint").alias("document_id"))


@query("f27_coa_view", "SELECT coa_id, line_item_name, broad_category FROM fx_coa WHERE statement = 'P&L'", ("fx_coa",))
def f27(t):
    return V.coa_view(t.coa, "P&L").select("coa_id", "line_item_name", "broad_category")


@query("f27_coa_view_whole", "SELECT coa_id, line_item_name, statement, broad_category FROM fx_coa", ("fx_coa",))
def f27c(t):
    return V.coa_view(t.coa).select("coa_id", "line_item_name", "statement", "broad_category")


@query("f27_coa_counts", "SELECT statement, count(*) AS n FROM fx_coa GROUP BY 1", ("fx_coa",))
def f27b(t):
    return t.coa.groupBy("statement").agg(F.count(F.lit(1)).alias("n"))


@query("f28_validation_view", """SELECT d.document_id, b.year AS balance_year, b.difference, b.is_balanced, r.* EXCLUDE (document_id) FROM fx_documents d
LEFT JOIN bal b ON b.document_id = d.document_id AND b.headline LEFT JOIN recon r ON r.document_id = d.document_id""", ("fx_documents", *COA), {**CROSSFOOT, **BAL})
def f28(t):
    from ..operators import reconcile as Q
    return V.validation_view(t.documents, balance(t), Q.recon_summary(crossfooted(t)[1]))


@query("f29_statement_view", f"""SELECT s.document_id, s.extraction_id, s.statement_type, n.note_number, EXISTS (SELECT 1 FROM np WHERE np.document_id = s.document_id AND np.note_number = n.note_number) AS has_note, f.fy1
FROM sr s JOIN nr n USING (document_id, extraction_id) LEFT JOIN ({FY.format(k='extraction_id', t='fx_row_values')}) f USING (document_id, extraction_id) WHERE s.statement_scope = 'consolidated'""",
       ("fx_pages", "fx_rows", "fx_row_values"), {**NOTES, "sr": SCOPED, "nr": NOTED})
def f29(t):
    rows = scoped_rows(t).join(noted_rows(t).select("document_id", "extraction_id", "note_ref"), ["document_id", "extraction_id"])
    return V.statement_view(rows, P.note_pages(sectioned(t)), t.row_values, "consolidated").select("document_id", "extraction_id", "statement_type", "note_number", "has_note", "fy1")


@query("f29_statement_view_whole", f"""SELECT s.document_id, s.extraction_id, s.statement_type, n.note_number, EXISTS (SELECT 1 FROM np WHERE np.document_id = s.document_id AND np.note_number = n.note_number) AS has_note, f.fy1
FROM sr s JOIN nr n USING (document_id, extraction_id) LEFT JOIN ({FY.format(k='extraction_id', t='fx_row_values')}) f USING (document_id, extraction_id)""",
       ("fx_pages", "fx_rows", "fx_row_values"), {**NOTES, "sr": SCOPED, "nr": NOTED})
def f29c(t):
    rows = scoped_rows(t).join(noted_rows(t).select("document_id", "extraction_id", "note_ref"), ["document_id", "extraction_id"])
    return V.statement_view(rows, P.note_pages(sectioned(t)), t.row_values).select("document_id", "extraction_id", "statement_type", "note_number", "has_note", "fy1")


@query("f29_section_counts", "SELECT document_id, statement_type, count(*) AS n FROM sr WHERE statement_scope = 'standalone' GROUP BY ALL", ROWS, {"sr": SCOPED})
def f29b(t):
    return V.rows_by_document(scoped_rows(t).filter("statement_scope = 'standalone'")).groupBy("document_id", "statement_type").agg(F.count(F.lit(1)).alias("n"))


@query("f30_review_view", f"""SELECT s.document_id, s.rn AS extraction_id, s.raw_field, s.score, f.fy1, f.fy2 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY raw_field) AS INT) AS rn FROM sc) s
LEFT JOIN ({FY.format(k='extraction_id', t='fx_row_values')}) f ON f.document_id = s.document_id AND f.extraction_id = s.rn WHERE s.review_status = 'needs_review' OR coalesce(s.score, 1.0) < 0.8""", (*CAN, "fx_row_values"), SC)
def f30(t):
    return V.review_view(numbered_scored(t), t.row_values).select("document_id", "extraction_id", "raw_field", "score", "fy1", "fy2")


@query("f31_tier_filter", """SELECT 'raw' AS tier, count(*) AS n FROM sc UNION ALL SELECT 'canonical', count(*) FROM sc WHERE field IS NOT NULL UNION ALL SELECT 'reviewed', count(*) FROM sc WHERE review_status = 'auto_approved'""", CAN, SC)
def f31(t):
    s = scored(t)
    return N.union_all([V.tier_filter(s, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("tier"), "n") for k in ("raw", "canonical", "reviewed")])


@query("f32_to_usd", """SELECT v.document_id, v.extraction_id, v.year, round(v.value * CASE d.currency_code WHEN 'GBP' THEN 1.2653 WHEN 'INR' THEN 0.01203 ELSE 1.0 END, 4) AS value_usd
FROM fx_row_values v JOIN fx_documents d USING (document_id)""", ("fx_row_values", "fx_documents"))
def f32(t):
    j = t.row_values.join(t.documents.select("document_id", "currency_code"), "document_id")
    return j.select("document_id", "extraction_id", "year", F.round(X.to_usd("value", "currency_code"), 4).alias("value_usd"))


_USD = "CASE WHEN d.currency_code <> 'USD' THEN round(v.value * CASE d.currency_code WHEN 'GBP' THEN 1.2653 WHEN 'INR' THEN 0.01203 ELSE 1.0 END, 4) END"


@query("f33_statement_sheet", f"""SELECT v.document_id, v.extraction_id, v.raw_label, v.year, max(v.value) AS value, max({_USD}) AS usd
FROM fx_row_values v JOIN fx_documents d USING (document_id) WHERE v.value IS NOT NULL GROUP BY ALL""", ("fx_row_values", "fx_documents"))
def f33(t):
    """The sheet's year columns, whichever the data has, turned back into rows."""
    s, years = V.statement_sheet(t.rows, t.row_values, t.documents), V.years_of(t.row_values)
    cells = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"`{y}`").alias("value"), F.round(f"`{y}_USD`", 4).alias("usd")) for y in years]))
    return s.select("document_id", "extraction_id", "raw_label", cells.alias("c")).select("document_id", "extraction_id", "raw_label", "c.year", "c.value", "c.usd").filter("value IS NOT NULL")


@query("f33_sheet_with_confidence", """SELECT r.document_id, r.extraction_id, r.raw_label, round(r.confidence, 2) AS confidence, count(v.value) AS n_values FROM routed r
LEFT JOIN fx_row_values v ON v.document_id = r.document_id AND v.extraction_id = r.extraction_id GROUP BY r.document_id, r.extraction_id, r.raw_label, r.confidence""", COA, RT)
def f33b(t):
    s = V.statement_sheet(t.rows, t.row_values, t.documents, scores=routed(t).select("document_id", "extraction_id", "confidence"))
    filled = sum((F.col(f"`{y}`").isNotNull().cast("bigint") for y in V.years_of(t.row_values)), F.lit(0).cast("bigint"))
    return s.select("document_id", "extraction_id", "raw_label", "confidence", filled.alias("n_values"))


@query("f34_summary_sheet", """UNPIVOT (SELECT a.*, b.checks_passed, b.checks_failed FROM (SELECT document_id, count(*) AS total, count(*) FILTER (review_status = 'auto_approved') AS auto_approved,
  count(*) FILTER (review_status = 'needs_review') AS needs_review, count(*) FILTER (score >= 0.80) AS at_least_080 FROM sc GROUP BY 1) a
LEFT JOIN (SELECT document_id, count(*) FILTER (status = 'passed') AS checks_passed, count(*) FILTER (status = 'failed') AS checks_failed FROM ck GROUP BY 1) b USING (document_id))
ON COLUMNS(* EXCLUDE (document_id)) INTO NAME metric VALUE n""".replace("UNPIVOT (", "SELECT * FROM (UNPIVOT (", 1) + ")", CAN, SC)
def f34(t):
    return V.summary_sheet(scored(t), checks(t))


@query("f35_metadata_sheet", """SELECT * FROM (UNPIVOT (SELECT document_id, count(*) FILTER (mapping_method = 'dictionary') AS method_dictionary, count(*) FILTER (mapping_method = 'model') AS method_model,
  count(*) FILTER (mapping_method = 'override') AS method_override, count(*) FILTER (score < 0.5) AS confidence_below_050, count(*) FILTER (score >= 0.5 AND score < 0.7) AS confidence_050_070,
  count(*) FILTER (score >= 0.7 AND score < 0.8) AS confidence_070_080, count(*) FILTER (score >= 0.8 AND score < 0.92) AS confidence_080_092, count(*) FILTER (score >= 0.92) AS confidence_from_092
FROM sc GROUP BY 1) ON COLUMNS(* EXCLUDE (document_id)) INTO NAME metric VALUE n)""", CAN, SC)
def f35(t):
    return V.metadata_sheet(scored(t))


@query("f36_validation_sheet", "SELECT document_id, check_id, name, status, round(lhs, 2) AS lhs, round(rhs, 2) AS rhs, round(diff_pct * 10000) / 100 AS diff_percent FROM ck", CAN, {"ck": CHECKS})
def f36(t):
    return V.validation_sheet(checks(t)).withColumns({"lhs": F.round("lhs", 2), "rhs": F.round("rhs", 2)})


@query("f36_raw_sheet", """SELECT r.document_id, r.extraction_id, r.raw_label, CASE WHEN is_subtotal THEN 'Yes' ELSE 'No' END AS subtotal, v.n AS n_years FROM fx_rows r
JOIN (SELECT document_id, extraction_id, count(*) AS n FROM fx_row_values GROUP BY ALL) v USING (document_id, extraction_id)""", ("fx_rows", "fx_row_values"))
def f36b(t):
    s = V.raw_sheet(t.rows, t.row_values)
    n = F.size(F.from_json("values_json", "map<string,double>")).cast("bigint")
    return s.select("document_id", "extraction_id", "raw_label", "subtotal", n.alias("n_years"))


@query("f37_unmapped_sheet", """SELECT r.document_id, r.extraction_id, r.status, s.best, coalesce(s.others, '') AS others, v."1995", v."1998" FROM routed r
LEFT JOIN (SELECT document_id, extraction_id, arg_min(coa_id, rn) AS best, string_agg(coa_id || ' (' || printf('%.2f', score) || ')', ', ' ORDER BY rn) FILTER (rn > 1) AS others FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, extraction_id ORDER BY score DESC, cand_rank) AS rn FROM fx_suggestions) x GROUP BY ALL) s USING (document_id, extraction_id)
LEFT JOIN (SELECT document_id, extraction_id, max(CASE WHEN year = '1995' THEN value END) AS "1995", max(CASE WHEN year = '1998' THEN value END) AS "1998" FROM fx_row_values GROUP BY ALL) v USING (document_id, extraction_id)
WHERE r.status IN ('unmapped', 'not_spread')""", SUG, RT)
def f37(t):
    s = V.unmapped_sheet(routed(t), t.suggestions, t.row_values)
    return s.select("document_id", "extraction_id", "status", "best", F.coalesce("others", F.lit("")).alias("others"), "1995", "1998")


@query("f37_unmapped_sheet_whole", """SELECT r.document_id, r.extraction_id, r.extraction_id::VARCHAR AS source_ids, v.year, v.value FROM routed r JOIN fx_row_values v USING (document_id, extraction_id)
WHERE r.status IN ('unmapped', 'not_spread') AND v.value IS NOT NULL""", SUG, RT)
def f37d(t):
    """Every year column of the sheet, turned back into rows."""
    s, years = V.unmapped_sheet(routed(t), t.suggestions, t.row_values), V.years_of(t.row_values)
    cells = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"`{y}`").alias("value")) for y in years]))
    return s.select("document_id", "extraction_id", "source_ids", cells.alias("c")).select("document_id", "extraction_id", "source_ids", "c.year", "c.value").filter("value IS NOT NULL")


@query("f37_confidence_sheet", "SELECT h.document_id, h.coa_id, round(h.confidence, 2) AS confidence, CASE WHEN h.confidence >= 0.9 THEN 'green' WHEN h.confidence >= 0.75 THEN 'amber' WHEN h.confidence >= 0.6 THEN 'orange' ELSE 'red' END AS band FROM h", COA, {**RT, "h": HEADS})
def f37b(t):
    h = V.confidence_rows(A.mapping_heads(routed(t)), t.coa)
    return h.select("document_id", "coa_id", F.round("confidence", 2).alias("confidence"), X.display_band("confidence", "sheet").alias("band"))


@query("f37_usage_sheet", """SELECT coalesce(stage, 'TOTAL') AS stage, CAST(sum(calls) AS BIGINT) AS calls, round(sum(cost), 6) AS cost_usd FROM uc GROUP BY ROLLUP (stage)""", ("fx_usage",), {"used": USED, "uc": _cost_sql("")})
def f37c(t):
    return N.usage_rollup(usage(t)).select(F.coalesce("stage", F.lit("TOTAL")).alias("stage"), "calls", "cost_usd")


@query("f38_display_bands", """SELECT document_id, raw_field, CASE WHEN score >= 0.9 THEN 'green' WHEN score >= 0.75 THEN 'amber' ELSE 'red' END AS web, CASE WHEN score >= 0.9 THEN 'green' WHEN score >= 0.75 THEN 'amber' WHEN score >= 0.6 THEN 'orange' ELSE 'red' END AS sheet,
  CASE WHEN score >= 0.9 THEN 'green' WHEN score >= 0.7 THEN 'amber' ELSE 'red' END AS bar, CASE WHEN score * 100 >= 90 THEN 'green' WHEN score * 100 >= 60 THEN 'amber' ELSE 'red' END AS health FROM sc""", CAN, SC)
def f38(t):
    s = scored(t)
    return s.select("document_id", "raw_field", *[X.display_band(F.col("score") * (100 if k == "health" else 1), k).alias(k) for k in X.BAND_SCHEMES])


@query("f39_status_tallies", """SELECT 'needs_review' AS metric, count(*) AS n FROM sc WHERE review_status = 'needs_review' UNION ALL SELECT 'approved', count(*) FROM sc WHERE review_status = 'auto_approved'
UNION ALL SELECT 'errors', count(*) FROM ck WHERE status = 'failed' UNION ALL SELECT 'ocr_pages', count(*) FROM o_class WHERE cls <> 'digital'""", (*CAN, "fx_pages"), {**CLS, **SC})
def f39(t):
    return V.status_tallies(scored(t), checks(t), P.page_summary(classified(t)))


@query("f40_spread_header", """SELECT d.document_id, d.filename, coalesce(m, 0) AS mappings, b.is_balanced, b.difference, coalesce(p, 0) AS pending FROM fx_documents d
LEFT JOIN (SELECT document_id, count(DISTINCT coa_id) AS m FROM routed WHERE status = 'mapped' GROUP BY 1) x USING (document_id) LEFT JOIN (SELECT * FROM bal WHERE headline) b USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS p FROM routed WHERE status = 'unmapped' GROUP BY 1) y USING (document_id)""", (*COA, "fx_documents"), BAL)
def f40(t):
    return V.spread_header(t.documents, A.mapping_heads(routed(t)), balance(t), routed(t)).select("document_id", "filename", "mappings", "is_balanced", "difference", "pending")


EXPORT_SQL = """SELECT document_id, count(*) AS n_rows, count(*) FILTER (canonical_field LIKE '%assets%' OR canonical_field LIKE '%liab%' OR canonical_field IN ('total_equity', 'partners_capital')) AS n_balance
FROM fx_canonical GROUP BY 1"""


@query("a08_export_json", EXPORT_SQL, CAN)
def a08(t):
    """Documents as JSON, parsed again: the counts of rows per bucket."""
    kinds = R.canonical_fields_frame(t.spark).select(F.col("canonical_field").alias("raw_field"), "statement_type")
    rows = numbered_scored(t).join(kinds, "raw_field", "left").withColumnRenamed("raw_field", "raw_label")
    docs = t.documents.withColumn("unit_scale", F.lit("units"))
    js = sinks.export_json(docs, rows, checks(t), "raw")
    n = lambda k: F.coalesce(F.size(F.from_json(F.get_json_object("json", f"$.statements.{k}"), "array<struct<raw_label:string>>")), F.lit(0))
    total = sum([n(k) for k in ("income_statement", "cash_flow", "equity_statement", "other")], n("balance_sheet"))
    return js.groupBy("document_id").agg(F.sum(total).alias("n_rows"), F.sum(n("balance_sheet")).alias("n_balance"))


@query("a09_export_raw_json", """SELECT document_id, extraction_id, raw_label, is_subtotal FROM fx_rows""", ROWS)
def a09(t):
    js = sinks.export_raw_json(t.rows, t.row_values)
    item = "array<struct<extraction_id:int,raw_label:string,is_subtotal:boolean>>"
    return js.select("document_id", F.inline(F.from_json(F.get_json_object("json", "$.rows"), item)))


@query("a10_write_report", """SELECT 'summary' AS sheet, count(*) * 6 AS n FROM (SELECT DISTINCT document_id FROM sc) a UNION ALL SELECT 'metadata', count(*) * 8 FROM (SELECT DISTINCT document_id FROM sc) b
UNION ALL SELECT 'validation', count(*) FROM ck UNION ALL SELECT 'usage', count(*) + 1 FROM (SELECT DISTINCT stage FROM fx_usage) c""", (*CAN, "fx_usage"), SC)
def a10(t):
    frames = {"summary": V.summary_sheet(scored(t), checks(t)), "metadata": V.metadata_sheet(scored(t)), "validation": V.validation_sheet(checks(t)),
              "usage": N.usage_rollup(usage(t)).select("stage", "calls", "cost_usd")}
    back = sinks.write_report(frames, None)
    return N.union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("sheet"), "n") for k, df in back.items()])
