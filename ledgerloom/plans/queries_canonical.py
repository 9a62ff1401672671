"""Registered canonical-mapping and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from ..operators import canonical as C
from ..operators import checks as K
from ..operators import rows as W
from ..sources import readers
from .catalog import query
from .queries_rows import STORED, _RULES, stored_rules

LAB, CAN = ("fx_labels",), ("fx_canonical",)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(expr: str) -> str:
    for p in (R.ROMAN_PREFIX, R.ARABIC_PREFIX, R.LETTER_PREFIX, R.ROMAN_PAREN_PREFIX):
        expr = f"regexp_replace({expr}, {_q(p)}, '')"
    for p in (R.NOTE_REFERENCE, R.QUALIFIERS, r"\s+"):
        expr = f"regexp_replace({expr}, {_q(p)}, {_q(' ' if p == chr(92) + 's+' else '')}, 'g')"
    return f"lower(trim({expr}))"


_ABBR = "CASE n " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in R.ABBREVIATIONS.items()) + " ELSE n END"
NORMED = f"SELECT * EXCLUDE (n), {_ABBR} AS normalized_label FROM (SELECT *, {_strip('raw_label')} AS n FROM fx_labels) t"
RULES = f"{_RULES} UNION ALL {STORED}"
FOUND = """SELECT template_type, normalized_label, arg_min(canonical_field, (tier, rule_ord)) AS field,
  arg_min(conf, (tier, rule_ord)) AS conf, min(tier) AS tier FROM (
  SELECT l.template_type, l.normalized_label, r.canonical_field, r.rule_ord,
    CASE WHEN r.rule_label = l.normalized_label AND r.template_type IS NOT NULL THEN 1 WHEN r.rule_label = l.normalized_label THEN 2 ELSE 3 END AS tier,
    CASE WHEN r.rule_label = l.normalized_label THEN r.rule_confidence ELSE greatest(r.rule_confidence - 0.15, 0.4) END AS conf
  FROM (SELECT DISTINCT template_type, normalized_label FROM nl) l JOIN rl r
    ON (r.template_type IS NULL OR r.template_type = l.template_type)
   AND (contains(l.normalized_label, r.rule_label) OR contains(r.rule_label, l.normalized_label))) c GROUP BY ALL"""
LOOKED = """SELECT nl.*, f.field AS canonical_field, coalesce(f.conf, 0.0) AS confidence, f.tier FROM nl LEFT JOIN found f USING (template_type, normalized_label)"""
DIS = {"nl": NORMED, "rl": RULES, "found": FOUND, "looked": LOOKED}


def looked(t):
    rules = readers.load_rules(t.spark, stored_rules(t))
    return C.dictionary_lookup(t.labels.withColumn("normalized_label", X.normalize_label("raw_label")), rules)


@query("d01_normalize_label", "SELECT row_id, raw_label, normalized_label FROM nl", LAB, {"nl": NORMED})
def d01(t):
    return t.labels.select("row_id", "raw_label", X.normalize_label("raw_label").alias("normalized_label"))


@query("d02_dictionary_lookup", "SELECT row_id, normalized_label, canonical_field, round(confidence, 6) AS confidence, CAST(tier AS INT) AS tier, CASE WHEN tier IS NULL THEN 'model' ELSE 'dictionary' END AS mapping_method FROM looked", LAB, DIS)
def d02(t):
    return looked(t).select("row_id", "normalized_label", "canonical_field", F.round("confidence", 6).alias("confidence"), "tier", "mapping_method")


def _rule_case(value: int) -> str:
    out = "CASE "
    for r in R.DISAMBIGUATION_RULES:
        cond = f"normalized_label = {_q(r[0])} AND statement_type = {_q(r[1])}" + (" AND contains(lower(section), 'investing')" if r[2] else "")
        v = _q(r[value]) if isinstance(r[value], str) else str(r[value]).lower()
        out += f"WHEN canonical_field IS NOT NULL AND {cond} THEN {v} "
    return out + "END"


@query("d03_disambiguate", f"""SELECT row_id, coalesce({_rule_case(3)}, canonical_field) AS canonical_field,
  round(least(confidence, coalesce(CAST({_rule_case(4)} AS DOUBLE), confidence)), 6) AS confidence, coalesce({_rule_case(5)}, false) AS flag_for_review FROM looked""",
       LAB, DIS)
def d03(t):
    d = C.disambiguate(looked(t).withColumn("section_path", F.array("section")))
    return d.select("row_id", "canonical_field", F.round("confidence", 6).alias("confidence"), "flag_for_review")


LATEST = "SELECT document_id, max(year) AS primary_year FROM fx_row_values GROUP BY document_id"
PRIMARY = """SELECT r.document_id, r.extraction_id, r.statement_type, r.section_no, r.raw_label, r.is_subtotal, v.value
FROM fx_rows r JOIN py ON py.document_id = r.document_id
LEFT JOIN fx_row_values v ON v.document_id = r.document_id AND v.extraction_id = r.extraction_id AND v.year = py.primary_year"""
PV = {"py": LATEST, "pv": PRIMARY}
RV = ("fx_rows", "fx_row_values")


def primary_rows(t):
    return C.primary_values(t.row_values, C.primary_year(t.row_values),
                            ["document_id", "extraction_id", "statement_type", "section_no", "raw_label", "is_subtotal"])


@query("d04_build_statement_tree", """SELECT document_id, statement_type, g AS group_no, max(CASE WHEN is_subtotal THEN extraction_id END) AS subtotal_id,
  max(CASE WHEN is_subtotal THEN value END) AS value, count(*) FILTER (NOT is_subtotal) AS n_children,
  round(sum(CASE WHEN NOT is_subtotal THEN coalesce(value, 0) END), 2) AS children_sum,
  CASE WHEN max(CASE WHEN is_subtotal THEN value END) IS NOT NULL AND count(*) FILTER (NOT is_subtotal) > 0 THEN
    abs(max(CASE WHEN is_subtotal THEN value END) - sum(CASE WHEN NOT is_subtotal THEN coalesce(value, 0) END)) <= 0.005 * abs(max(CASE WHEN is_subtotal THEN value END))
    OR max(CASE WHEN is_subtotal THEN value END) = 0 END AS sum_valid
FROM (SELECT *, CAST(coalesce(sum(CASE WHEN is_subtotal THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, statement_type ORDER BY extraction_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g FROM pv) t GROUP BY ALL""", RV, PV)
def d04(t):
    return C.build_statement_tree(primary_rows(t)).select("document_id", "statement_type", "group_no", "subtotal_id", "value", "n_children",
                                                          F.round("children_sum", 2).alias("children_sum"), "sum_valid")


@query("d05_infer_subtotals", """SELECT document_id, parent_field, count(*) AS n_children, round(sum(value), 2) AS inferred_value FROM (
  SELECT document_id, value, CASE WHEN canonical_field IN ('current_assets', 'non_current_assets') THEN 'total_assets'
    WHEN canonical_field IN ('share_capital', 'retained_earnings', 'partners_capital') THEN 'total_equity' END AS parent_field,
    canonical_field LIKE 'total%' AND document_id % 2 = 0 AS s FROM fx_canonical) k
WHERE parent_field IS NOT NULL AND NOT s AND value IS NOT NULL AND document_id % 2 = 1 GROUP BY ALL HAVING count(*) >= 2""", CAN)
def d05(t):
    rows = t.canonical.withColumn("is_subtotal", F.col("canonical_field").like("total%") & (F.col("document_id") % 2 == 0))
    out = C.infer_subtotals(rows, R.canonical_fields_frame(t.spark), ["total_assets", "total_equity"])
    return out.select("document_id", "parent_field", "n_children", F.round("inferred_value", 2).alias("inferred_value"))


FREQUENT = """SELECT document_id, year AS primary_year FROM (SELECT document_id, year, row_number() OVER (PARTITION BY document_id
  ORDER BY count(*) DESC, year) AS rn FROM fx_row_values GROUP BY document_id, year) t WHERE rn = 1"""


@query("d06_primary_year", f"SELECT document_id, a.primary_year AS latest, b.primary_year AS frequent FROM py a JOIN ({FREQUENT}) b USING (document_id)",
       ("fx_row_values",), {"py": LATEST})
def d06(t):
    a = C.primary_year(t.row_values).withColumnRenamed("primary_year", "latest")
    return a.join(C.primary_year(t.row_values, "frequent").withColumnRenamed("primary_year", "frequent"), "document_id")


@query("d07_canonical_map", """SELECT document_id, raw_label AS canonical_field, value FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, raw_label ORDER BY extraction_id DESC) AS rn FROM pv) t WHERE rn = 1""", RV, PV)
def d07(t):
    return C.canonical_map(primary_rows(t).withColumn("canonical_field", F.col("raw_label")))


def _checks_sql() -> str:
    fields = K._fields()
    wide = ", ".join(f"max(CASE WHEN canonical_field = '{f}' THEN value END) AS {f}" for f in fields)

    def total(names):
        return (f"CASE WHEN coalesce({', '.join(names)}) IS NOT NULL THEN " + " + ".join(f"coalesce({n}, 0)" for n in names) + " END")

    sides = {
        "V01": ("total_assets", "total_liabilities + total_equity"), "V02": ("profit_before_tax", "total_income - total_expenses"),
        "V03": ("net_income", "profit_before_tax - income_tax_expense"), "V04": ("total_comprehensive_income", "net_income + other_comprehensive_income"),
        "V05": ("cash_end", total(R.CASH_COMPONENTS)), "V06": ("total_revenue", total(R.REVENUE_COMPONENTS)),
        "V07": ("total_expenses", total(R.EXPENSE_COMPONENTS)), "V08": ("total_assets", "current_assets + non_current_assets"),
        "V09": ("closing_equity", "opening_equity + coalesce(total_comprehensive_income, net_income, 0) - abs(coalesce(dividends_paid, 0))"),
        "V10": ("eps_basic", "CASE WHEN template_type IN ('T1','T3','T4') AND weighted_avg_shares <> 0 THEN net_income / weighted_avg_shares END"),
        "V11": ("CASE WHEN template_type = 'T6' THEN partners_capital END", "total_equity"),
        "V12": ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    }
    parts = []
    for k, (left, right) in sides.items():
        name, formula, tol = R.VALIDATION_CHECKS[k]
        parts.append(f"SELECT document_id, template_type, '{k}' AS check_id, {_q(name)} AS name, {_q(formula)} AS formula, {tol} AS tol, "
                     f"CAST({left} AS DOUBLE) AS l, CAST({right} AS DOUBLE) AS r FROM w")
    present = " + ".join(f"CAST(coalesce({', '.join(f)}) IS NOT NULL AS INT)" for f in R.STATEMENT_INDICATORS.values())
    body = " UNION ALL ".join(parts)
    return (f"WITH w AS (SELECT document_id, template_type, {wide} FROM fx_canonical GROUP BY document_id, template_type), s AS ({body}), "
            "d AS (SELECT *, l IS NOT NULL AND r IS NOT NULL AS b, abs(l - r) / greatest(abs(l), abs(r), 1.0) AS diff FROM s) "
            "SELECT document_id, template_type, check_id, name, formula, CAST(tol AS DOUBLE) AS tolerance, "
            "CASE WHEN NOT b THEN 'skipped' WHEN diff <= tol THEN 'passed' ELSE 'failed' END AS status, CASE WHEN b THEN l END AS lhs, "
            "CASE WHEN b THEN r END AS rhs, round(CASE WHEN b THEN diff END, 6) AS diff_pct FROM d UNION ALL "
            f"SELECT document_id, template_type, 'V13', {_q(R.VALIDATION_CHECKS['V13'][0])}, {_q(R.VALIDATION_CHECKS['V13'][1])}, 0.0, "
            f"CASE WHEN p = 4 THEN 'passed' ELSE 'failed' END, p, 4, round((4 - p) / 4.0 * 100, 6) FROM (SELECT *, {present} AS p FROM w) x")


CHECKS = _checks_sql()


def checks(t):
    return K.run_validations(t.canonical)


for _n, _check in enumerate(R.VALIDATION_CHECKS, 1):
    @query(f"v{_n:02d}_{'_'.join(R.VALIDATION_CHECKS[_check][0].lower().replace('=', '').replace('-', ' ').replace(chr(39), '').split())}",
           f"SELECT document_id, template_type, status, round(lhs, 2) AS lhs, round(rhs, 2) AS rhs, diff_pct FROM ck WHERE check_id = '{_check}'",
           CAN, {"ck": CHECKS})
    def _v(t, check=_check):
        return checks(t).filter(F.col("check_id") == check).select("document_id", "template_type", "status", F.round("lhs", 2).alias("lhs"),
                                                                   F.round("rhs", 2).alias("rhs"), "diff_pct")


@query("v_run_validations", "SELECT document_id, template_type, check_id, name, formula, tolerance, status, round(lhs, 2) AS lhs, round(rhs, 2) AS rhs, diff_pct FROM ck",
       CAN, {"ck": CHECKS})
def v_all(t):
    return checks(t).withColumns({"lhs": F.round("lhs", 2), "rhs": F.round("rhs", 2)})


@query("d08_validation_summary", """SELECT document_id, string_agg(check_id || ':' || status, ',' ORDER BY check_id) AS statuses,
  count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped
FROM ck GROUP BY document_id""", CAN, {"ck": CHECKS})
def d08(t):
    s = K.validation_summary(checks(t))
    return s.withColumn("statuses", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ","))


def engine_rows(t):
    """Canonical rows with a dictionary confidence; total_expenses stays unmapped, every seventh filing is scanned."""
    d = F.col("document_id")
    return t.canonical.withColumns({
        "confidence": F.when(F.col("canonical_field") == "total_expenses", 0.0).otherwise(F.lit(0.80) + (d % 20) / 100),
        "ocr": d % 7 == 0, "raw_field": F.col("canonical_field"),
        "mapping_method": F.when(F.col("canonical_field") == "total_expenses", "model").otherwise("dictionary"),
        "canonical_field": F.when(F.col("canonical_field") != "total_expenses", F.col("canonical_field"))})


SCORED = """SELECT *, CASE WHEN score >= 0.92 THEN 'auto_approved' ELSE 'needs_review' END AS review_status FROM (
SELECT e.*, round(least(greatest(conf * 0.5 + CASE WHEN field IS NULL THEN 0.5 ELSE 0.9 END * 0.2
  + CASE WHEN field IS NULL THEN 0.8 WHEN EXISTS (SELECT 1 FROM ck WHERE ck.document_id = e.document_id AND status = 'failed' AND contains(formula, field)) THEN 0.3 ELSE 1.0 END * 0.2
  + 0.08 - CASE WHEN document_id % 7 = 0 THEN 0.05 ELSE 0 END, 0), 1), 6) AS score
FROM (SELECT document_id, template_type, canonical_field AS raw_field, value, CASE WHEN canonical_field <> 'total_expenses' THEN canonical_field END AS field,
  CASE WHEN canonical_field = 'total_expenses' THEN 'model' ELSE 'dictionary' END AS mapping_method,
  CAST(CASE WHEN canonical_field = 'total_expenses' THEN 0 ELSE 0.80 + (document_id % 20) / 100.0 END AS DOUBLE) AS conf FROM fx_canonical) e) s"""
SC = {"ck": CHECKS, "sc": SCORED}


def scored(t):
    return C.score_confidence(engine_rows(t), checks(t))


@query("d09_score_confidence", "SELECT document_id, raw_field, field AS canonical_field, CAST(score AS DOUBLE) AS score, review_status FROM sc", CAN, SC)
def d09(t):
    return scored(t).select("document_id", "raw_field", "canonical_field", "score", "review_status")


@query("d10_unmatched", "SELECT document_id, raw_field, CAST(score AS DOUBLE) AS score FROM sc WHERE mapping_method = 'model' AND score <= 0.35", CAN, SC)
def d10(t):
    return C.unmatched(scored(t)).select("document_id", "raw_field", "score")


@query("d11_apply_fallback", """SELECT document_id, raw_field, CASE WHEN u THEN ans ELSE field END AS canonical_field,
  CAST(CASE WHEN u THEN round(least(a_conf * 0.5 + 0.42, 1.0), 6) ELSE score END AS DOUBLE) AS score,
  CASE WHEN NOT u THEN review_status WHEN round(least(a_conf * 0.5 + 0.42, 1.0), 6) >= 0.92 THEN 'auto_approved' ELSE 'needs_review' END AS review_status
FROM (SELECT *, (document_id % 11) / 10.0 AS a_conf, CASE WHEN document_id % 2 = 0 THEN 'total_expenses' ELSE 'carried_interest' END AS ans,
  field IS NULL AND (document_id % 2 = 0 OR template_type = 'T2') AS u FROM sc) t""", CAN, SC)
def d11(t):
    d = F.col("document_id")
    answers = t.documents.select("document_id", F.lit(1).alias("extraction_id"),
                                 F.when(d % 2 == 0, "total_expenses").otherwise("carried_interest").alias("answer_field"),
                                 ((d % 11) / 10).alias("answer_confidence"))
    rows = scored(t).withColumn("extraction_id", F.when(F.col("raw_field") == "total_expenses", 1).otherwise(0))
    return C.apply_fallback(rows, answers, R.canonical_fields_frame(t.spark)).select("document_id", "raw_field", "canonical_field", "score", "review_status")


@query("d12_health_score", """SELECT document_id, CASE WHEN n IS NULL THEN 100 ELSE CAST(round(p / greatest(n - s, 1) * 100.0) AS INT) END AS api_health,
  CASE WHEN coalesce(n - s, 0) = 0 THEN 100 ELSE CAST(round(p / greatest(n - s, 1) * 100.0) AS INT) END AS list_health
FROM fx_documents LEFT JOIN (SELECT document_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (status = 'passed') AS DOUBLE) AS p,
  count(*) FILTER (status = 'skipped') AS s FROM ck GROUP BY document_id) c USING (document_id)""", ("fx_documents", "fx_canonical"), {"ck": CHECKS})
def d12(t):
    return K.health_score(t.documents, checks(t))


def review_rows(t):
    return scored(t).withColumn("row_id", F.concat_ws("/", F.col("document_id"), F.col("raw_field")))


def review_decisions(t):
    """Two rounds of decisions on the total_assets rows; some decide only the value, some nothing."""
    e = t.raw("events").filter("event_type IN ('purchase', 'view')")
    i = F.col("event_id")
    return e.select(i.alias("decision_id"), F.col("ts").alias("decided_at"), F.concat(F.col("user_id").cast("string"), F.lit("/total_assets")).alias("row_id"),
                    F.when(i % 3 == 0, F.concat(F.lit("field_"), (i % 5).cast("string"))).alias("new_field"),
                    F.when(i % 3 != 2, F.col("value")).alias("new_value"), F.lit("analyst").alias("reviewer"), F.col("event_type").alias("reason"))


DECIDED = """SELECT event_id AS decision_id, ts AS decided_at, user_id AS document_id, CASE WHEN event_id % 3 = 0 THEN concat('field_', event_id % 5) END AS new_field
FROM events WHERE event_type IN ('purchase', 'view') AND event_id % 3 <> 2"""


@query("d13_apply_overrides", """SELECT s.document_id, s.raw_field, coalesce(l.new_field, s.field) AS canonical_field,
  CASE WHEN l.document_id IS NULL THEN review_status ELSE 'reviewed' END AS review_status, CASE WHEN l.document_id IS NULL THEN mapping_method ELSE 'override' END AS mapping_method
FROM sc s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY decided_at DESC, decision_id DESC) AS rn FROM dd) x WHERE rn = 1) l
  ON l.document_id = s.document_id AND s.raw_field = 'total_assets'""", CAN, {**SC, "dd": DECIDED})
def d13(t):
    return C.apply_overrides(review_rows(t), review_decisions(t))[0].select("document_id", "raw_field", "canonical_field", "review_status", "mapping_method")


@query("d13_override_audit", """SELECT d.decision_id, s.document_id, s.field AS old_field, d.new_field, round(s.value, 2) AS old_value
FROM dd d JOIN sc s ON s.document_id = d.document_id AND s.raw_field = 'total_assets'""", CAN, {**SC, "dd": DECIDED})
def d13b(t):
    audit = C.apply_overrides(review_rows(t), review_decisions(t))[1]
    return audit.select("decision_id", F.split("row_id", "/")[0].cast("bigint").alias("document_id"), "old_field", "new_field", F.round("old_value", 2).alias("old_value"))


@query("d14_bulk_approve", """SELECT document_id, raw_field, CASE WHEN score >= 0.85 THEN 'auto_approved' ELSE review_status END AS strict, 'auto_approved' AS compat FROM sc""",
       CAN, SC)
def d14(t):
    s = scored(t)
    a = C.bulk_approve(s, 0.85).withColumnRenamed("review_status", "strict")
    return C.bulk_approve(a.withColumn("review_status", F.col("strict")), compat=True).select("document_id", "raw_field", "strict", F.col("review_status").alias("compat"))


def comparatives(t):
    """Each year's filing reports its year and, sometimes restated, the year before."""
    v = t.row_values.select(F.col("document_id").alias("company"), F.col("extraction_id").alias("canonical_field"), F.col("year").cast("int").alias("year"), "value")
    again = v.withColumn("fiscal_year", F.col("year") + 1).withColumn("value", F.when(F.col("canonical_field") % 5 == 0, F.col("value") * 1.02).otherwise(F.col("value")))
    return v.withColumn("fiscal_year", F.col("year")).unionByName(again)


@query("d15_yoy_check", """SELECT document_id AS company, extraction_id AS canonical_field, CAST(year AS INT) + 1 AS fiscal_year, round(value, 2) AS reported,
  CASE WHEN extraction_id % 5 = 0 AND value * 0.02 / greatest(value * 1.02, 1.0) > 0.001 THEN 'failed' ELSE 'passed' END AS status FROM fx_row_values""", ("fx_row_values",))
def d15(t):
    return K.yoy_check(comparatives(t)).select("company", "canonical_field", "fiscal_year", F.round("reported", 2).alias("reported"), "status")


@query("d16_to_units", """SELECT document_id, extraction_id, year, value * CASE document_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1e3 WHEN 2 THEN 1e5 WHEN 3 THEN 1e6
  WHEN 4 THEN 1e7 ELSE 1e9 END AS value FROM fx_row_values""", ("fx_row_values",))
def d16(t):
    scale = F.element_at(F.array(*map(F.lit, R.UNIT_SCALES)), (F.col("document_id") % 6 + 1).cast("int"))
    return t.row_values.select("document_id", "extraction_id", "year", X.to_units("value", scale).alias("value"))


@query("d_ontology_gap", f"SELECT canonical_field, count(*) AS n_rules FROM ({RULES}) r WHERE canonical_field NOT IN ({', '.join(_q(f[0]) for f in R.CANONICAL_FIELDS if f[0] != 'other_income')}) GROUP BY 1")
def d_gap(t):
    fields = R.canonical_fields_frame(t.spark).filter("canonical_field <> 'other_income'")
    return C.ontology_gap(readers.load_rules(t.spark, stored_rules(t)), fields)
