"""Registered chart-of-accounts queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from ..operators import coa as A
from ..operators import learning as L
from ..operators import reconcile as Q
from .catalog import query

ROUTED = """SELECT r.*, CASE WHEN r.statement_type = 'equity_statement' THEN 'not_spread' WHEN r.statement_type = 'cash_flow' THEN 'skipped'
  WHEN a.confidence >= 0.55 THEN 'mapped' ELSE 'unmapped' END AS status,
  CASE WHEN a.confidence >= 0.55 THEN a.coa_id END AS coa_id, CASE WHEN a.confidence >= 0.55 THEN a.confidence END AS confidence
FROM fx_rows r LEFT JOIN fx_answers a USING (document_id, extraction_id)"""
SIGNED = """SELECT v.document_id, v.extraction_id, m.coa_id, v.year, v.value AS raw_value,
  CASE WHEN c.sign_convention IN ('contra', 'negative') THEN -abs(v.value) ELSE v.value END AS value
FROM fx_row_values v JOIN routed m ON m.document_id = v.document_id AND m.extraction_id = v.extraction_id AND m.status = 'mapped'
LEFT JOIN fx_coa c ON c.coa_id = m.coa_id"""
AGG = """SELECT document_id, coa_id, year, sum(value) AS value, count(*) AS n_values, bool_or(value <> raw_value) AS sign_applied FROM signed GROUP BY document_id, coa_id, year"""
BALANCE = """SELECT *, CASE WHEN total_assets <> 0 THEN abs(difference) / abs(total_assets) < 0.001 ELSE abs(difference) < 1e-9 END AS is_balanced,
  year = max(year) OVER (PARTITION BY document_id) AS headline FROM (
  SELECT document_id, year, total_assets, total_liabilities, total_equity, round(total_assets - (total_liabilities + total_equity), 2) + 0.0 AS difference FROM (
    SELECT s.document_id, s.year, coalesce(sum(value) FILTER (NOT is_subtotal AND broad_category IN ('Current Assets', 'Non-Current Assets')), 0) AS total_assets,
      coalesce(sum(value) FILTER (NOT is_subtotal AND broad_category IN ('Current Liabilities', 'Non-Current Liabilities')), 0) AS total_liabilities,
      coalesce(sum(value) FILTER (NOT is_subtotal AND broad_category = 'Equity'), 0) AS total_equity
    FROM signed s JOIN fx_coa c ON c.coa_id = s.coa_id AND c.statement = 'Balance Sheet' GROUP BY s.document_id, s.year) a) b"""
COA, RT = ("fx_rows", "fx_row_values", "fx_coa", "fx_answers"), {"routed": ROUTED}
SG = {**RT, "signed": SIGNED}
AG = {**SG, "agg": AGG}
BAL = {**AG, "bal": BALANCE}


def routed(t):
    """The written stage: every row with its outcome."""
    return t.stage("routed", lambda: A.route(t.rows, t.answers))


def signed(t):
    """The written stage: signed values of the mapped rows."""
    return t.stage("signed", lambda: A.signed_values(routed(t), t.row_values, t.coa))


def aggregated(t):
    return A.aggregate_mappings(signed(t))


def balance(t):
    return A.balance_identity(signed(t), t.coa)


@query("e01_gate_rows", """SELECT document_id, extraction_id, CASE statement_type WHEN 'balance_sheet' THEN 'Balance Sheet' WHEN 'income_statement' THEN 'P&L' END AS coa_statement,
  CASE WHEN statement_type IN ('balance_sheet', 'income_statement') THEN 'map' WHEN statement_type = 'equity_statement' THEN 'not_spread' ELSE 'skipped' END AS gate FROM fx_rows""",
       ("fx_rows",))
def e01(t):
    return A.gate_rows(t.rows).select("document_id", "extraction_id", "coa_statement", "gate")


KEYED = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("e02_label_key", f"SELECT row_id, raw_label, {KEYED.format('raw_label')} AS label_key FROM fx_labels", ("fx_labels",))
def e02(t):
    return t.labels.select("row_id", "raw_label", X.label_key("raw_label").alias("label_key"))


# Half of the labels lose their first word, so that only a containing pattern can match them.
LROWS = f"""SELECT document_id, extraction_id, statement_type, template_type, {KEYED.format('raw_label')} AS label_key FROM (
SELECT r.document_id, r.extraction_id, r.statement_type, d.template_type,
  CASE WHEN extraction_id % 2 = 0 THEN substring(raw_label, strpos(raw_label, ' ') + 1) ELSE raw_label END AS raw_label
FROM fx_rows r JOIN fx_documents d USING (document_id)) t"""
LHITS = """SELECT * FROM (SELECT r.*, l.learned_id, l.coa_id, l.learned_confidence AS confidence, l.times_applied, l.times_overridden, tier,
  row_number() OVER (PARTITION BY r.document_id, r.extraction_id ORDER BY tier, l.created_seq DESC, l.learned_id DESC) AS rn
FROM lrows r JOIN tiers l ON l.k = r.label_key AND l.st = r.statement_type AND l.tt = r.template_type) t WHERE rn = 1"""
TIERS = """SELECT w.label_key AS k, w.statement_type AS st, w.template_type AS tt, l.*,
  CASE WHEN l.label_key = w.label_key AND l.template_type = w.template_type THEN 1 WHEN l.label_key = w.label_key AND l.template_type = '*' THEN 2 ELSE 3 END AS tier
FROM (SELECT DISTINCT label_key, statement_type, template_type FROM lrows WHERE label_key <> '') w JOIN fx_learned l
  ON l.statement_type = w.statement_type AND l.times_overridden < 2 AND contains(l.label_key, w.label_key)"""
LE = ("fx_rows", "fx_documents", "fx_learned")
LH = {"lrows": LROWS, "tiers": TIERS, "lhits": LHITS}


def learned_rows(t):
    lab = F.when(F.col("extraction_id") % 2 == 0, F.expr("substring(raw_label, locate(' ', raw_label) + 1)")).otherwise(F.col("raw_label"))
    return t.rows.join(t.documents.select("document_id", "template_type"), "document_id").withColumn("raw_label", lab)


def learned_hits(t):
    return t.stage("learned_hits", lambda: L.learned_lookup(learned_rows(t), t.learned))


@query("e03_learned_lookup", "SELECT document_id, extraction_id, CAST(tier AS INT) AS tier, learned_id, coa_id FROM lhits", LE, LH)
def e03(t):
    return L.learned_lookup(learned_rows(t), t.learned).select("document_id", "extraction_id", "tier", "learned_id", "coa_id")


@query("e04_feedback_rows", """SELECT document_id, extraction_id, learned_id, CAST(times_applied + k - 1 AS BIGINT) AS times_seen,
  CAST(CASE WHEN k > 1 AND times_applied + k - 1 >= 5 AND times_overridden = 0 THEN 0.99 ELSE confidence END AS DOUBLE) AS confidence_seen
FROM (SELECT *, row_number() OVER (PARTITION BY document_id, learned_id ORDER BY extraction_id) AS k FROM lhits) t""", LE, LH)
def e04(t):
    return L.apply_learning_feedback(learned_hits(t), t.learned)[0].select("document_id", "extraction_id", "learned_id", "times_seen", "confidence_seen")


@query("e04_feedback_learned", """SELECT learned_id, CAST(times_applied + coalesce(u, 0) AS BIGINT) AS times_applied,
  CAST(CASE WHEN u IS NOT NULL AND times_applied + u >= 5 AND times_overridden = 0 THEN 0.99 ELSE learned_confidence END AS DOUBLE) AS learned_confidence
FROM fx_learned LEFT JOIN (SELECT learned_id, count(*) AS u FROM lhits GROUP BY 1) h USING (learned_id)""", LE, LH)
def e04b(t):
    return L.apply_learning_feedback(learned_hits(t), t.learned)[1].select("learned_id", "times_applied", "learned_confidence")


@query("e04_last_applied", """SELECT l.learned_id, strftime(max(d.created_at), '%Y-%m-%d %H:%M:%S') AS last_applied_at FROM fx_learned l
LEFT JOIN lhits h USING (learned_id) LEFT JOIN fx_documents d ON d.document_id = h.document_id GROUP BY l.learned_id""", LE, LH)
def e04c(t):
    hits = learned_hits(t).join(t.documents.select("document_id", F.col("created_at").alias("used_at")), "document_id")
    after = L.apply_learning_feedback(hits, t.learned, "used_at")[1]
    return after.select("learned_id", F.date_format("last_applied_at", "yyyy-MM-dd HH:mm:ss").alias("last_applied_at"))


@query("e05_attribution", """SELECT learned_id, concat('Mapped using analyst learning from ', source_document, ' (applied 2024-01-31). Original rationale: ', rationale,
  ' Confidence inherited: 0.95. Applied ', times_applied, ' time(s) previously.') AS message FROM fx_learned""", ("fx_learned",))
def e05(t):
    return t.learned.withColumn("applied_on", F.lit("2024-01-31")).select("learned_id", L.attribution().alias("message"))


@query("e06_candidates", f"""SELECT r.document_id, r.extraction_id, CAST(b.rn AS INT) AS cand_rank, b.coa_id, b.score FROM (
  SELECT *, CASE statement_type WHEN 'balance_sheet' THEN 'Balance Sheet' WHEN 'income_statement' THEN 'P&L' END AS cs, {KEYED.format('raw_label')} AS k FROM fx_rows) r
JOIN (SELECT *, row_number() OVER (PARTITION BY cs, k ORDER BY score DESC, coa_id) AS rn FROM (
  SELECT w.cs, w.k, c.coa_id, round(0.7 * len(list_intersect(w.toks, c.toks)) / len(list_distinct(list_concat(w.toks, c.toks)))
      + 0.3 * (1 - levenshtein(w.k, c.n) / CAST(greatest(length(w.k), length(c.n)) AS DOUBLE)), 6) AS score
  FROM (SELECT DISTINCT CASE statement_type WHEN 'balance_sheet' THEN 'Balance Sheet' WHEN 'income_statement' THEN 'P&L' END AS cs, {KEYED.format('raw_label')} AS k,
          list_distinct(string_split({KEYED.format('raw_label')}, ' ')) AS toks FROM fx_rows) w
  JOIN (SELECT coa_id, statement, line_item_name AS n, list_distinct(string_split(line_item_name, ' ')) AS toks FROM fx_coa) c ON c.statement = w.cs) s) b ON b.cs = r.cs AND b.k = r.k AND b.rn <= 3""", ("fx_rows", "fx_coa"))
def e06(t):
    return A.candidates(t.rows, t.coa).select("document_id", "extraction_id", "cand_rank", "coa_id", "score")


def raw_answers(t):
    """Batch answers with refusals, foreign and unknown ids, confidences out of range and gaps; single answers for all."""
    e = F.col("extraction_id")
    batch = t.answers.filter(e % 8 != 7).withColumns({
        "coa_id": F.when(e % 8 == 0, "UNMAPPED").when(e % 8 == 1, "XX-999").when(e % 8 == 2, "").otherwise(F.col("coa_id")),
        "confidence": F.when(e % 8 == 3, F.col("confidence") + 1.5).otherwise(F.col("confidence"))})
    single = t.answers.filter(e % 16 != 15).withColumn("coa_id", F.when(e % 16 == 7, "ZZ-1").otherwise(F.col("coa_id")))
    return batch, single


VALID = """SELECT document_id, extraction_id, coa_id, CAST(CASE WHEN coa_id IS NULL THEN 0.0 ELSE confidence END AS DOUBLE) AS confidence,
  CASE WHEN NOT (hb OR hs) OR (NOT hb AND e16 = 7 AND fv IS NULL) THEN 'mapping_failed' ELSE 'ok' END AS answer_status
FROM (SELECT *, CASE WHEN NOT (hb OR hs) THEN NULL WHEN hb AND e8 IN (0, 2) THEN NULL WHEN (hb AND e8 = 1) OR (NOT hb AND e16 = 7) THEN fv ELSE a_id END AS coa_id
  FROM (SELECT r.document_id, r.extraction_id, a.confidence, a.coa_id AS a_id, r.extraction_id % 8 AS e8, r.extraction_id % 16 AS e16,
      a.coa_id IS NOT NULL AND r.extraction_id % 8 NOT IN (3, 7) AS hb, a.coa_id IS NOT NULL AND r.extraction_id % 16 <> 15 AS hs, f.fv
    FROM fx_rows r LEFT JOIN fx_answers a USING (document_id, extraction_id)
    LEFT JOIN (SELECT document_id, extraction_id, arg_min(coa_id, cand_rank) AS fv FROM fx_suggestions WHERE score > 0.3 GROUP BY ALL) f USING (document_id, extraction_id)
    WHERE r.statement_type IN ('balance_sheet', 'income_statement')) x) y"""


@query("e07_validate_suggestions", VALID, ("fx_answers", "fx_suggestions"))
def e07(t):
    batch, single = raw_answers(t)
    out = A.validate_suggestions(t.rows, batch, t.suggestions.filter("score > 0.3"), t.coa, single)
    return out.select("document_id", "extraction_id", "coa_id", "confidence", "answer_status")


@query("e08_route", "SELECT document_id, extraction_id, status, coa_id, confidence FROM routed", COA, RT)
def e08(t):
    return A.route(t.rows, t.answers).select("document_id", "extraction_id", "status", "coa_id", "confidence")


@query("e09_apply_sign", "SELECT document_id, extraction_id, coa_id, year, value, value <> raw_value AS changed FROM signed", COA, SG)
def e09(t):
    return A.signed_values(routed(t), t.row_values, t.coa).select("document_id", "extraction_id", "coa_id", "year", "value", "changed")


@query("e10_aggregate_mappings", "SELECT document_id, coa_id, year, round(value, 2) AS value, n_values, sign_applied FROM agg", COA, AG)
def e10(t):
    return aggregated(t).withColumn("value", F.round("value", 2))


@query("e10_mapping_heads", """SELECT document_id, coa_id, count(*) AS aggregated_from, min(extraction_id) AS first_row, arg_min(raw_label, extraction_id) AS raw_label,
  arg_min(confidence, extraction_id) AS confidence, CASE WHEN count(*) > 1 THEN concat('[Aggregated from ', count(*), ' source rows.]') ELSE '' END AS rationale_note
FROM routed WHERE status = 'mapped' GROUP BY document_id, coa_id""", COA, RT)
def e10b(t):
    return A.mapping_heads(routed(t)).select("document_id", "coa_id", "aggregated_from", "first_row", "raw_label", "confidence", "rationale_note")


@query("e10_mapping_sources", """SELECT document_id, coa_id, CAST((extraction_id - 1) // 10000 AS INT) AS part_no, string_agg(raw_label, ' + ' ORDER BY extraction_id) AS labels,
  string_agg(CAST(extraction_id AS VARCHAR), ',' ORDER BY extraction_id) AS ids FROM routed WHERE status = 'mapped' GROUP BY ALL""", COA, RT)
def e10c(t):
    return A.mapping_sources(routed(t)).select("document_id", "coa_id", "part_no", "labels", F.array_join("source_extraction_ids", ",").alias("ids"))


OUTCOMES = """SELECT document_id, lower(trim(raw_label)) AS label, statement_type, arg_max(CASE WHEN status = 'mapped' THEN 'mapped' ELSE 'unmapped' END, extraction_id) AS status,
  max(extraction_id) AS extraction_id FROM routed WHERE status <> 'skipped' GROUP BY ALL"""


@query("e11_outcomes", "SELECT * FROM outc", COA, {**RT, "outc": OUTCOMES})
def e11(t):
    return A.outcomes(routed(t)).select("document_id", "label", "statement_type", "status", "extraction_id")


@query("e12_row_outcomes", """SELECT document_id, extraction_id, raw_label, CASE WHEN status = 'skipped' THEN 'not_spread' ELSE status END AS mapping_status, coa_id, confidence FROM routed""", COA, RT)
def e12(t):
    return A.row_outcomes(t.rows, routed(t)).select("document_id", "extraction_id", "raw_label", "mapping_status", "coa_id", "confidence")


@query("e13_spread_summary", """SELECT document_id, CAST(0 AS BIGINT) AS learned, count(*) FILTER (status = 'mapped') AS model, count(*) FILTER (status = 'unmapped') AS unmapped,
  count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'not_spread') AS equity,
  CASE WHEN count(*) FILTER (status = 'unmapped') > 0 THEN 'has_unmapped' ELSE 'spread_complete' END AS spread_status FROM routed GROUP BY document_id""", COA, RT)
def e13(t):
    return A.spread_summary(routed(t))


@query("e13_spread_summary_learned", """SELECT document_id, count(*) FILTER (s = 'learned') AS learned, count(*) FILTER (s = 'mapped') AS model, count(*) FILTER (s = 'unmapped') AS unmapped,
  count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'not_spread') AS equity, CASE WHEN count(*) FILTER (s = 'unmapped') > 0 THEN 'has_unmapped' ELSE 'spread_complete' END AS spread_status
FROM (SELECT r.document_id, CASE WHEN h.learned_id IS NOT NULL AND r.status IN ('mapped', 'unmapped') THEN 'learned' ELSE r.status END AS s FROM routed r LEFT JOIN lhits h USING (document_id, extraction_id)) x GROUP BY document_id""",
       (*COA, "fx_documents", "fx_learned"), {**RT, **LH})
def e13b(t):
    hits = learned_hits(t).select("document_id", "extraction_id", "coa_id", "confidence", "learned_id")
    return A.spread_summary(A.route(t.rows, t.answers, hits))


@query("e14_balance_identity", """SELECT document_id, year, round(total_assets, 2) AS total_assets, round(total_liabilities, 2) AS total_liabilities, round(total_equity, 2) AS total_equity,
  difference, is_balanced, headline FROM bal""", COA, BAL)
def e14(t):
    return balance(t).withColumns({c: F.round(c, 2) for c in ("total_assets", "total_liabilities", "total_equity")})


@query("e15_imbalance_contributors", """SELECT document_id, year, coa_id, line_item_name, round(value, 2) AS value, CAST(rn AS INT) AS rank_no FROM (
  SELECT a.document_id, a.year, a.coa_id, c.line_item_name, a.value, row_number() OVER (PARTITION BY a.document_id ORDER BY round(abs(a.value), 2) DESC, a.coa_id) AS rn
  FROM agg a JOIN bal b ON b.document_id = a.document_id AND b.year = a.year AND b.headline AND NOT b.is_balanced
  JOIN fx_coa c ON c.coa_id = a.coa_id AND c.statement = 'Balance Sheet' AND NOT c.is_subtotal) t WHERE rn <= 5""", COA, BAL)
def e15(t):
    agg = aggregated(t).withColumn("value", F.round("value", 2))
    return A.imbalance_contributors(agg, t.coa, balance(t)).select("document_id", "year", "coa_id", "line_item_name", "value", "rank_no")


LEAVES = """SELECT s.*, c.statement, c.broad_category FROM signed s JOIN (SELECT document_id, max(year) AS year FROM signed GROUP BY 1) y USING (document_id, year)
JOIN fx_coa c ON c.coa_id = s.coa_id AND NOT c.is_subtotal"""


@query("e16_category_subtotals", "SELECT document_id, statement, broad_category, year, round(sum(value), 2) + 0.0 AS total FROM lv GROUP BY ALL", COA, {**SG, "lv": LEAVES})
def e16(t):
    return A.category_subtotals(signed(t), t.coa).withColumn("total", F.round("total", 2) + 0.0)


@query("e16_category_rollup", "SELECT statement, broad_category, round(sum(value), 0) AS total, count(*) AS n_values FROM lv GROUP BY ROLLUP (statement, broad_category)", COA, {**SG, "lv": LEAVES})
def e16b(t):
    return A.category_subtotals(signed(t), t.coa, rollup=True).withColumn("total", F.round("total", 0))


def recon_rows(t):
    """Rows with three levels: the total of section 0 is the statement's own total."""
    return t.rows.withColumn("indentation_level", F.when(F.col("is_subtotal"), F.when(F.col("section_no") == 4, 0).otherwise(1)).otherwise(2))


def _foots_sql(total: str, ext: str) -> str:
    return f"(abs({total} - {ext}) <= 1.0 OR ({ext} <> 0 AND abs({total} - {ext}) / abs({ext}) < 0.001))"


def _sum_sql(rows: str) -> str:
    """Sum of the rows' values at the headline year; null where one is missing."""
    return f"CASE WHEN len({rows}) = 0 THEN 0 WHEN len([x.vals[y] for x in {rows} if x.vals[y] IS NULL]) > 0 THEN NULL ELSE list_sum([x.vals[y] for x in {rows}]) END"


#: Grouping as a recursion over the subtotals of a statement: what is free, and the newest subtotal of each level.
GROUPED = {
    "sc": """SELECT document_id, statement_type, extraction_id AS id, raw_label, is_subtotal, CASE WHEN is_subtotal THEN CASE WHEN section_no = 4 THEN 0 ELSE 1 END ELSE 2 END AS lvl
  FROM fx_rows WHERE coalesce(statement_type, '') NOT IN ('', 'cash_flow', 'equity_statement')""",
    "own": """SELECT *, min(CASE WHEN is_subtotal THEN id END) OVER (PARTITION BY document_id, statement_type ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS parent,
  min(lvl) OVER (PARTITION BY document_id, statement_type) = max(lvl) OVER (PARTITION BY document_id, statement_type) AS flat FROM sc""",
    "rv": "SELECT document_id, extraction_id AS id, year, value FROM fx_row_values",
    "hd": """SELECT o.document_id, o.statement_type, o.id, o.lvl, o.raw_label, o.flat, max(v.year) AS y, arg_max_null(v.value, v.year) AS ext, map(coalesce(list(v.year ORDER BY v.year) FILTER (v.year IS NOT NULL), []), coalesce(list(v.value ORDER BY v.year) FILTER (v.year IS NOT NULL), [])) AS vals
  FROM own o LEFT JOIN rv v ON v.document_id = o.document_id AND v.id = o.id WHERE o.is_subtotal GROUP BY ALL""",
    "lf": """SELECT h.document_id, h.id, count(*) AS n, count(v.value) AS known, sum(v.value) AS s FROM own l JOIN hd h ON h.document_id = l.document_id AND h.id = l.parent
  LEFT JOIN rv v ON v.document_id = l.document_id AND v.id = l.id AND v.year = h.y WHERE NOT l.is_subtotal GROUP BY ALL""",
    "sb": """SELECT h.*, coalesce(lf.n, 0) AS n_leaves, CASE WHEN lf.known = lf.n THEN lf.s END AS leaf_sum, row_number() OVER (PARTITION BY h.document_id, h.statement_type ORDER BY h.id) AS k
  FROM hd h LEFT JOIN lf USING (document_id, id)""",
    "walk": f"""WITH RECURSIVE w AS (
    SELECT DISTINCT document_id, statement_type, 0::BIGINT AS k, NULL::INT AS id, NULL::VARCHAR AS method, []::INT[] AS gone, []::STRUCT(id INT, vals MAP(VARCHAR, DOUBLE))[] AS free, []::STRUCT(id INT, lvl INT)[] AS seen FROM sb
    UNION ALL
    SELECT document_id, statement_type, k, id, CASE WHEN ok THEN 'leaves' WHEN more IS NOT NULL THEN 'absorbed' ELSE 'unresolved' END, gone,
      list_append([x for x in free if NOT list_contains(gone, x.id)], {{'id': id, 'vals': vals}}), list_append(seen, {{'id': id, 'lvl': lvl}})
    FROM (SELECT *, [x.id for x in list_concat(CASE WHEN more IS NOT NULL THEN old[len(old) - more + 1:] ELSE [] END, near)] AS gone
      FROM (SELECT *, CASE WHEN NOT ok AND su > ab THEN list_min([n for n in range(1, len(old) + 1) if {_foots_sql("(total + " + _sum_sql("old[len(old) - n + 1:]") + ")", "ext")}]) END AS more
        FROM (SELECT *, coalesce(y IS NULL OR ((n_leaves > 0 OR len(near) > 0) AND {_foots_sql("total", "ext")}), false) AS ok
          FROM (SELECT *, CASE WHEN n_leaves > 0 THEN leaf_sum ELSE 0 END + {_sum_sql("near")} AS total
            FROM (SELECT *, [x for x in free if x.id > su] AS near, [x for x in free if x.id > ab AND x.id <= su] AS old
              FROM (SELECT w.free, w.seen, s.*, coalesce(list_max([x.id for x in w.seen if x.lvl <= s.lvl]), 0) AS su, coalesce(list_max([x.id for x in w.seen if x.lvl < s.lvl]), 0) AS ab
                FROM w JOIN sb s ON s.document_id = w.document_id AND s.statement_type = w.statement_type AND s.k = w.k + 1) a) b) c) d) e) f)
  SELECT document_id, statement_type, id, method, gone FROM w WHERE k > 0""",
    "comps": """SELECT document_id, statement_type, parent AS subtotal_id, id AS component_id FROM own WHERE NOT is_subtotal AND parent IS NOT NULL
  UNION ALL SELECT document_id, statement_type, id, unnest(gone) FROM walk""",
}
#: Cross-footing of the components, per year and at the headline year.
CROSSFOOT = {
    **GROUPED, "routed": ROUTED, "outc": OUTCOMES,
    "years": f"""SELECT *, CASE WHEN whole THEN total - extracted END AS difference, CASE WHEN whole THEN {_foots_sql("total", "extracted")} END AS passed
  FROM (SELECT s.document_id, s.statement_type, s.id AS subtotal_id, e.year, e.value AS extracted, coalesce(c.total, 0) AS total,
      e.value IS NOT NULL AND coalesce(n.n, 0) > 0 AND coalesce(c.known, 0) = n.n AS whole
    FROM sb s JOIN rv e ON e.document_id = s.document_id AND e.id = s.id
    LEFT JOIN (SELECT document_id, subtotal_id, count(*) AS n FROM comps GROUP BY ALL) n ON n.document_id = s.document_id AND n.subtotal_id = s.id
    LEFT JOIN (SELECT c.document_id, c.subtotal_id, v.year, sum(v.value) AS total, count(v.value) AS known FROM comps c JOIN rv v ON v.document_id = c.document_id AND v.id = c.component_id GROUP BY ALL) c
      ON c.document_id = s.document_id AND c.subtotal_id = s.id AND c.year = e.year) y""",
    "states": """SELECT c.*, coalesce(o.status, 'absent') AS status, r.raw_label FROM comps c JOIN sc r ON r.document_id = c.document_id AND r.id = c.component_id
  LEFT JOIN outc o ON o.document_id = c.document_id AND o.label = lower(trim(r.raw_label)) AND o.statement_type = c.statement_type""",
    "report": """SELECT s.document_id, s.statement_type, s.id AS subtotal_id, s.raw_label, s.lvl AS indentation_level, s.y AS headline, w.method, CASE WHEN s.flat THEN 'low' ELSE 'high' END AS grouping_confidence,
    h.passed, h.difference, coalesce(u.has_unmapped, false) AS has_unmapped, coalesce(u.n, 0) AS n_components
  FROM sb s JOIN walk w USING (document_id, id)
  LEFT JOIN (SELECT document_id, subtotal_id, arg_max_null(passed, year) AS passed, arg_max_null(difference, year) AS difference FROM years GROUP BY ALL) h ON h.document_id = s.document_id AND h.subtotal_id = s.id
  LEFT JOIN (SELECT document_id, subtotal_id, bool_or(status <> 'mapped') AS has_unmapped, count(*) AS n FROM states GROUP BY ALL) u ON u.document_id = s.document_id AND u.subtotal_id = s.id""",
    "recon": """SELECT document_id, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS incomplete,
  count(*) FILTER (has_unmapped) AS with_unmapped_component, count(*) FILTER (grouping_confidence = 'low') AS low_confidence_grouping FROM report GROUP BY document_id""",
}


def grouped(t):
    return t.stages(("components", "subtotals"), lambda: Q.group_subtotals(recon_rows(t), t.row_values, keep=t.stored))


@query("e17_group_subtotals", """SELECT s.document_id, s.statement_type, s.id AS subtotal_id, s.y AS headline, w.method, n.n AS n_components FROM sb s JOIN walk w USING (document_id, id)
LEFT JOIN (SELECT document_id, subtotal_id, count(*) AS n FROM comps GROUP BY ALL) n ON n.document_id = s.document_id AND n.subtotal_id = s.id""", ("fx_rows", "fx_row_values"), GROUPED)
def e17(t):
    comps, subs = grouped(t)
    n = comps.groupBy("document_id", "subtotal_id").agg(F.count(F.lit(1)).alias("n_components"))
    return subs.join(n, ["document_id", "subtotal_id"], "left").select("document_id", "statement_type", "subtotal_id", "headline", "method", "n_components")


@query("e17_leaf_components", """SELECT document_id, statement_type, subtotal_id, extraction_id AS component_id FROM (
  SELECT *, min(CASE WHEN is_subtotal THEN extraction_id END) OVER (PARTITION BY document_id, statement_type ORDER BY extraction_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS subtotal_id
  FROM fx_rows WHERE statement_type IN ('balance_sheet', 'income_statement')) t WHERE NOT is_subtotal AND subtotal_id IS NOT NULL""", ("fx_rows",))
def e17b(t):
    comps = grouped(t)[0]
    leaves = t.rows.filter("NOT is_subtotal").select("document_id", F.col("extraction_id").alias("component_id"))
    return comps.join(leaves, ["document_id", "component_id"], "left_semi").select("document_id", "statement_type", "subtotal_id", "component_id")


def given_groups(t):
    """Components given from outside: every section total adds up the leaves of its section."""
    r = t.rows.filter("statement_type IN ('balance_sheet', 'income_statement') AND section_no < 2")
    s = r.filter("is_subtotal").select("document_id", "statement_type", "section_no", F.col("extraction_id").alias("subtotal_id"))
    leaf = r.filter("NOT is_subtotal").select("document_id", "statement_type", "section_no", F.col("extraction_id").alias("component_id"))
    return s.join(leaf, ["document_id", "statement_type", "section_no"]).drop("section_no")


def flat_grouped(t):
    return t.stages(("flat_components", "flat_subtotals"), lambda: Q.group_subtotals(t.rows.withColumn("indentation_level", F.lit(0)), t.row_values, given_groups(t), t.stored))


@query("e18_given_groups", """SELECT document_id, statement_type, subtotal_id, component_id FROM (SELECT s.document_id, s.statement_type, s.extraction_id AS subtotal_id, l.extraction_id AS component_id
FROM fx_rows s JOIN fx_rows l ON l.document_id = s.document_id AND l.statement_type = s.statement_type AND l.section_no = s.section_no AND NOT l.is_subtotal
WHERE s.is_subtotal AND s.section_no < 2 AND s.statement_type IN ('balance_sheet', 'income_statement')) t""", ("fx_rows",))
def e18(t):
    comps, subs = flat_grouped(t)
    return comps.join(subs.filter("method = 'given'").select("document_id", "subtotal_id"), ["document_id", "subtotal_id"], "left_semi").select(
        "document_id", "statement_type", "subtotal_id", "component_id")


FLATSUB = """SELECT s.document_id, s.statement_type, s.extraction_id AS subtotal_id, s.section_no FROM fx_rows s
WHERE s.is_subtotal AND s.statement_type IN ('balance_sheet', 'income_statement') AND section_no < 2"""
FLATYEAR = """SELECT f.document_id, f.statement_type, f.subtotal_id, v.year, v.value AS extracted,
  coalesce((SELECT sum(l.value) FROM fx_row_values l WHERE l.document_id = f.document_id AND l.statement_type = f.statement_type AND l.section_no = f.section_no AND NOT l.is_subtotal AND l.year = v.year), 0) AS computed,
  (SELECT count(*) FROM fx_row_values l WHERE l.document_id = f.document_id AND l.statement_type = f.statement_type AND l.section_no = f.section_no AND NOT l.is_subtotal AND l.year = v.year) AS known,
  (SELECT count(*) FROM fx_rows l WHERE l.document_id = f.document_id AND l.statement_type = f.statement_type AND l.section_no = f.section_no AND NOT l.is_subtotal) AS n
FROM flat f JOIN fx_row_values v ON v.document_id = f.document_id AND v.extraction_id = f.subtotal_id"""


@query("e19_crossfoot_given", """SELECT document_id, statement_type, subtotal_id, year, extracted, round(computed, 2) AS computed,
  CASE WHEN known = n THEN round(computed - extracted, 2) + 0.0 END AS difference,
  CASE WHEN known = n THEN abs(computed - extracted) <= 1.0 OR (extracted <> 0 AND abs(computed - extracted) / abs(extracted) < 0.001) END AS passed FROM flaty""",
       ("fx_rows", "fx_row_values"), {"flat": FLATSUB, "flaty": FLATYEAR})
def e19b(t):
    comps, subs = flat_grouped(t)
    per_year, _ = Q.crossfoot(comps, subs.filter("method = 'given'"), t.rows, t.row_values, A.outcomes(routed(t)), t.stored)
    return per_year.withColumns({"computed": F.round("computed", 2), "difference": F.round("difference", 2) + 0.0})


def crossfooted(t):
    keep = lambda years: t.stage("crossfoot_years", lambda: years)
    return t.stages(("crossfoot_years", "crossfoot"), lambda: Q.crossfoot(*grouped(t), t.rows, t.row_values, A.outcomes(routed(t)), keep))


@query("e19_crossfoot", "SELECT document_id, statement_type, subtotal_id, year, extracted, round(total, 2) AS computed, round(difference, 2) + 0.0 AS difference, passed FROM years", COA, CROSSFOOT)
def e19(t):
    return crossfooted(t)[0].withColumns({"computed": F.round("computed", 2), "difference": F.round("difference", 2) + 0.0})


@query("e19_crossfoot_report", "SELECT * REPLACE (round(difference, 2) + 0.0 AS difference) FROM report", COA, CROSSFOOT)
def e19c(t):
    return crossfooted(t)[1].withColumn("difference", F.round("difference", 2) + 0.0)


@query("e20_sign_flip", "SELECT document_id, extraction_id, bool_or(raw_value <> 0 AND (raw_value < 0) <> (value < 0)) AS sign_flipped FROM signed GROUP BY ALL", COA, SG)
def e20(t):
    return Q.sign_flip(t.row_values, signed(t))


@query("e21_recon_summary", "SELECT * FROM recon", COA, CROSSFOOT)
def e21(t):
    return Q.recon_summary(crossfooted(t)[1])


@query("e22_format_spread", """SELECT d.document_id, CAST(row_number() OVER (PARTITION BY d.document_id, a.year_rank ORDER BY c.coa_id) AS INT) * 0 + CAST(c.no AS INT) AS line_no, c.coa_id, c.statement, v.year, round(v.value, 2) AS value
FROM fx_documents d JOIN (SELECT *, row_number() OVER (ORDER BY split_part(coa_id, '-', 1), CAST(split_part(coa_id, '-', 2) AS INT)) AS no FROM fx_coa) c ON true
LEFT JOIN (SELECT *, 1 AS year_rank FROM agg) v ON v.document_id = d.document_id AND v.coa_id = c.coa_id LEFT JOIN (SELECT 1 AS year_rank) a ON true""",
       ("fx_documents", *COA), AG)
def e22(t):
    return A.format_spread(t.documents, aggregated(t), A.mapping_heads(routed(t)), t.coa).select(
        "document_id", "line_no", "coa_id", "statement", "year", F.round("value", 2).alias("value"))
