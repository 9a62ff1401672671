"""Registered page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from ..operators import pages as P
from ..sources import readers
from ..streaming import streams
from .catalog import query


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SQ, _DQ = R.SINGLE_QUOTES, R.DOUBLE_QUOTES
NORM = "translate({0}, " + _lit(_SQ + _DQ) + ", " + _lit("'" * len(_SQ) + '"' * len(_DQ)) + ")"
_SIGNALS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_lit(p)}, {_lit(t)}, CAST({w} AS DOUBLE), {_lit(' '.join(h))})" for i, (p, t, w, h) in enumerate(R.STATEMENT_SIGNALS)
) + ") s(ord, pattern, statement_type, weight, hints)"
SCOPE = ("CASE WHEN regexp_matches(h, '(?i)\\bconsolidated\\b|\\bgroup\\b') THEN 'consolidated' "
         "WHEN regexp_matches(h, '(?i)\\bstandalone\\b|\\bparent\\s+entity\\b') "
         "OR len(regexp_extract_all(h, '(?i)\\bcompany\\b')) > len(regexp_extract_all(h, '(?i)\\bcompany\\s+act')) THEN 'standalone' "
         "ELSE 'unknown' END")

STATS = """SELECT document_id, page_number, drawing_count, text AS raw_text,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 1)) AS wc,
  CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / CAST(length(text) AS DOUBLE) ELSE 0.0 END AS ar
FROM fx_pages"""
CLASSED = """SELECT *, CASE WHEN cls = 'scanned' THEN '' ELSE raw_text END AS text FROM
(SELECT *, CASE WHEN wc >= 80 AND ar >= 0.90 THEN 'digital' WHEN wc >= 20 THEN 'hybrid' ELSE 'scanned' END AS cls FROM o_stats) t"""
HITS = f"""SELECT document_id, page_number, s.statement_type, min(s.ord) AS ord
FROM o_class p JOIN o_signals s ON regexp_matches({NORM.format('left(p.text, 2000)')}, s.pattern)
WHERE cls <> 'scanned' GROUP BY document_id, page_number, s.statement_type"""
SECTIONED = """SELECT p.*, CASE WHEN cls <> 'scanned' THEN coalesce(a.statement_type, 'other') END AS section_type,
  b.statement_type AS secondary_section_type
FROM o_class p
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY ord) AS rn FROM o_hits) a
  ON a.document_id = p.document_id AND a.page_number = p.page_number AND a.rn = 1
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY ord) AS rn FROM o_hits) b
  ON b.document_id = p.document_id AND b.page_number = p.page_number AND b.rn = 2"""
GROUPED = """SELECT DISTINCT document_id, section, page_number FROM (
  SELECT document_id, section_type AS section, page_number FROM o_sec WHERE cls <> 'scanned'
  UNION ALL SELECT document_id, secondary_section_type, page_number FROM o_sec WHERE cls <> 'scanned') t
WHERE section IS NOT NULL AND section <> 'other'"""
FOREIGN = f"""SELECT DISTINCT document_id, page_number, s.statement_type FROM o_class p JOIN o_signals s
ON s.statement_type <> 'notes' AND regexp_matches({NORM.format('p.text')}, s.pattern)"""
EXPANDED = """
SELECT document_id, section, page_number FROM o_group WHERE section <> 'notes'
UNION
SELECT document_id, section, page_number FROM (
  SELECT document_id, section, start, page_number, max(blocked) OVER (PARTITION BY document_id, section, start ORDER BY page_number) AS b
  FROM (SELECT g.document_id, g.section, g.page_number AS start, CAST(g.page_number + k.k AS INT) AS page_number,
          CASE WHEN p.document_id IS NULL OR p.cls = 'scanned' OR coalesce(p.section_type NOT IN ('other', 'notes'), false)
                 OR EXISTS (SELECT 1 FROM o_foreign f WHERE f.document_id = g.document_id AND f.page_number = g.page_number + k.k
                            AND f.statement_type <> g.section) THEN 1 ELSE 0 END AS blocked
        FROM o_group g CROSS JOIN (SELECT unnest(range(1, 9)) AS k) k
        LEFT JOIN o_sec p ON p.document_id = g.document_id AND p.page_number = g.page_number + k.k
        WHERE g.section <> 'notes') t) u
WHERE b = 0"""

BASE = {"o_stats": STATS}
CLS = {**BASE, "o_class": CLASSED}
SIG = {**CLS, "o_signals": _SIGNALS, "o_hits": HITS}
SEC = {**SIG, "o_sec": SECTIONED}
GRP = {**SEC, "o_group": GROUPED}
EXP = {**GRP, "o_foreign": FOREIGN, "o_exp": EXPANDED}
PAGES = ("fx_pages",)


def classified(t):
    return P.classify_pages(t.pages)


def sectioned(t):
    """The written stage: classified pages with their sections."""
    return t.stage("pages_sectioned", lambda: P.assign_sections(classified(t)))


@query("a01_read_pages", """SELECT page_id AS document_id, url, length(html) AS n_chars,
  len(list_filter(regexp_split_to_array(html, '\\s+'), lambda x: length(x) > 1)) AS word_count FROM pages""")
def a01(t):
    p = readers.read_pages(t.spark, f"{t.dir}/pages.parquet", id_col="page_id", text_col="html", keep=["url"])
    return p.select("document_id", "url", F.length("text").cast("bigint").alias("n_chars"), X.word_count("text").cast("bigint").alias("word_count"))


@query("b01_page_stats", "SELECT document_id, page_number, wc AS word_count, round(ar, 6) AS ascii_ratio FROM o_stats", PAGES, BASE)
def b01(t):
    return P.page_stats(t.pages).select("document_id", "page_number", F.col("word_count").cast("bigint").alias("word_count"),
                                        F.round("ascii_ratio", 6).alias("ascii_ratio"))


@query("b02_classify_pages", """SELECT document_id, page_number, cls AS classification, round(ar, 4) AS ascii_ratio,
  cls = 'scanned' AS requires_ocr, length(text) AS n_chars FROM o_class""", PAGES, CLS)
def b02(t):
    return classified(t).select("document_id", "page_number", "classification", "ascii_ratio", "requires_ocr",
                                F.length("text").cast("bigint").alias("n_chars"))


@query("b03_page_summary", """SELECT document_id, count(*) FILTER (cls = 'digital') AS digital, count(*) FILTER (cls = 'scanned') AS scanned,
  count(*) FILTER (cls = 'hybrid') AS hybrid, count(*) AS total, count(*) FILTER (cls <> 'digital') > 0 AS ocr_required
FROM o_class GROUP BY document_id""", PAGES, CLS)
def b03(t):
    return P.page_summary(classified(t))


@query("b04_normalize_heading", f"""SELECT document_id, page_number, length(n) AS n_chars,
  length(n) - length(replace(n, '''', '')) AS apostrophes, length(n) - length(replace(n, '"', '')) AS quotes
FROM (SELECT document_id, page_number, {NORM.format('text')} AS n FROM fx_pages) t""", PAGES)
def b04(t):
    n = X.normalize_heading("text")
    def count(ch):
        return (F.length(n) - F.length(F.replace(n, F.lit(ch), F.lit("")))).cast("bigint")
    return t.pages.select("document_id", "page_number", F.length(n).cast("bigint").alias("n_chars"), count("'").alias("apostrophes"),
                          count('"').alias("quotes"))


@query("b05_detect_statements", f"""SELECT h.document_id, h.page_number,
  CAST(row_number() OVER (PARTITION BY h.document_id, h.page_number ORDER BY h.ord) AS INT) AS rank, h.statement_type, s.weight AS confidence,
  regexp_extract({NORM.format('left(p.text, 2000)')}, s.pattern, 0) AS matched_text
FROM o_hits h JOIN o_signals s ON s.ord = h.ord JOIN o_class p ON p.document_id = h.document_id AND p.page_number = h.page_number
UNION ALL SELECT document_id, page_number, 1, 'other', CAST(1.0 AS DOUBLE), '' FROM o_class p
WHERE cls <> 'scanned' AND NOT EXISTS (SELECT 1 FROM o_hits h WHERE h.document_id = p.document_id AND h.page_number = p.page_number)""",
       PAGES, SIG)
def b05(t):
    return P.detect_statements(classified(t).filter("classification <> 'scanned'"))


@query("b06_assign_sections", "SELECT document_id, page_number, section_type, secondary_section_type FROM o_sec", PAGES, SEC)
def b06(t):
    return P.assign_sections(classified(t)).select("document_id", "page_number", "section_type", "secondary_section_type")


@query("b07_reroute_hybrid", """SELECT document_id, page_number, cls AS nominal_class,
  CASE WHEN cls = 'digital' AND drawing_count > 100 AND wc < 0.5 * drawing_count THEN 'scanned' ELSE cls END AS classification FROM o_class""",
       PAGES, CLS)
def b07(t):
    return P.reroute_hybrid(classified(t)).select("document_id", "page_number", "nominal_class", "classification")


@query("b08_group_sections", "SELECT document_id, section, page_number FROM o_group", PAGES, GRP)
def b08(t):
    return P.group_sections(sectioned(t))


@query("b09_note_pages", """SELECT document_id, CAST(coalesce(nullif(regexp_extract(text, '(?im)^note\\s+(\\d+)', 1), ''),
  nullif(regexp_extract(text, '(?m)^(\\d+)\\.\\s+[A-Z]', 1), '')) AS INT) AS note_number, page_number
FROM o_sec WHERE cls <> 'scanned' AND (section_type = 'notes' OR secondary_section_type = 'notes')
  AND coalesce(nullif(regexp_extract(text, '(?im)^note\\s+(\\d+)', 1), ''), nullif(regexp_extract(text, '(?m)^(\\d+)\\.\\s+[A-Z]', 1), '')) IS NOT NULL""",
       PAGES, SEC)
def b09(t):
    return P.note_pages(sectioned(t))


@query("b10_expand_continuation", "SELECT document_id, section, page_number FROM o_exp", PAGES, EXP)
def b10(t):
    return P.expand_continuation(sectioned(t))


@query("b11_reduction_ratio", """SELECT t.document_id, t.n AS total_pages, coalesce(s.n, 0) AS selected_pages,
  round(coalesce(s.n, 0) / CAST(t.n AS DOUBLE), 6) AS reduction
FROM (SELECT document_id, count(*) AS n FROM o_sec GROUP BY document_id) t
LEFT JOIN (SELECT document_id, count(DISTINCT page_number) AS n FROM o_exp GROUP BY document_id) s USING (document_id)""", PAGES, EXP)
def b11(t):
    s = sectioned(t)
    return P.reduction_ratio(s, P.expand_continuation(s))


def page_labels(t):
    """Labels of scanned pages, as a model would deliver them."""
    slot = (F.col("document_id") + F.col("page_number")) % 5
    kinds = [F.array(F.lit("balance_sheet")), F.array(F.lit("income_statement"), F.lit("cash_flow")), F.array(F.lit("notes")),
             F.array(F.lit("other")), F.array().cast("array<string>")]
    types = F.when(slot == 0, kinds[0]).when(slot == 1, kinds[1]).when(slot == 2, kinds[2]).when(slot == 3, kinds[3]).otherwise(kinds[4])
    conf = ((F.col("document_id") + F.col("page_number") * 3) % 10).cast("double") / 10
    return t.pages.select("document_id", "page_number", types.alias("statement_types"), conf.alias("label_confidence"))


_MERGED = """SELECT document_id, page_number, cls AS classification,
  CASE WHEN cls <> 'scanned' THEN section_type WHEN c < 0.7 OR k = 4 THEN 'other' WHEN k = 0 THEN 'balance_sheet' WHEN k = 1 THEN 'income_statement'
       WHEN k = 2 THEN 'notes' ELSE 'other' END AS section_type,
  CASE WHEN cls <> 'scanned' THEN secondary_section_type WHEN c >= 0.7 AND k = 1 THEN 'cash_flow' END AS secondary_section_type
FROM (SELECT *, (document_id + page_number) % 5 AS k, CAST((document_id + page_number * 3) % 10 AS DOUBLE) / 10 AS c FROM o_sec) t"""


@query("b12_merge_page_labels", _MERGED, PAGES, SEC)
def b12(t):
    return P.merge_page_labels(sectioned(t), page_labels(t)).select("document_id", "page_number", "classification", "section_type",
                                                                   "secondary_section_type")


@query("b12_labelled_selection", """SELECT DISTINCT document_id, section, page_number FROM (
  SELECT document_id, section_type AS section, page_number FROM m WHERE classification = 'scanned'
  UNION ALL SELECT document_id, secondary_section_type, page_number FROM m WHERE classification = 'scanned') t
WHERE section IS NOT NULL AND section NOT IN ('other', 'notes')""", PAGES, {**SEC, "m": _MERGED})
def b12b(t):
    return P.labelled_selection(P.merge_page_labels(sectioned(t), page_labels(t)))


@query("b13_detect_scope", f"SELECT document_id, page_number, {SCOPE} AS scope FROM (SELECT *, left(text, 500) AS h FROM fx_pages) t", PAGES)
def b13(t):
    return t.pages.select("document_id", "page_number", X.detect_scope("text").alias("scope"))


@query("b14_statement_scope", f"""SELECT f.document_id, f.section, f.page_number, {SCOPE} AS scope FROM
(SELECT document_id, section, min(page_number) AS page_number FROM o_exp GROUP BY document_id, section) f
JOIN (SELECT document_id, page_number, left(text, 500) AS h FROM o_sec) p ON p.document_id = f.document_id AND p.page_number = f.page_number""",
       PAGES, EXP)
def b14(t):
    s = sectioned(t)
    return P.statement_scope(s, P.expand_continuation(s))


_SEGMENTED = {
    "g": f"SELECT g.document_id, g.section, g.page_number, s.text, {NORM.format('s.text')} AS norm FROM o_group g JOIN o_sec s USING (document_id, page_number) WHERE g.section <> 'notes'",
    "ln": """SELECT document_id, page_number, i, lines[i] AS line, array_to_string(lines[i:i + 3], chr(10)) AS w FROM (
  SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT DISTINCT document_id, page_number, string_split(norm, chr(10)) AS lines FROM g) a) b""",
    "hd": """SELECT o.document_id, o.page_number, o.pos, arg_min(s.statement_type, s.ord) AS kind FROM (
  SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id, page_number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM ln) o
JOIN o_signals s ON s.statement_type <> 'notes' AND regexp_matches(o.w, '^[^\\n]{0,50}?(?:' || s.pattern || ')') GROUP BY ALL""",
    "own": """SELECT g.document_id, g.section, g.page_number, any_value(g.text) AS text, min(h.pos) AS first, min(h.pos) FILTER (h.kind = g.section) AS own
FROM g LEFT JOIN hd h USING (document_id, page_number) GROUP BY g.document_id, g.section, g.page_number""",
    "cut": """SELECT o.document_id, o.section, o.page_number, any_value(o.text) AS text, any_value(o.first) AS first,
  CASE WHEN any_value(o.own) IS NULL THEN left(any_value(o.text), any_value(o.first)) ELSE substring(any_value(o.text), any_value(o.own) + 1, coalesce(min(h.pos), length(any_value(o.text))) - any_value(o.own)) END AS c
FROM own o LEFT JOIN hd h ON h.document_id = o.document_id AND h.page_number = o.page_number AND h.kind <> o.section AND h.pos > o.own GROUP BY o.document_id, o.section, o.page_number""",
}


@query("b15_segment_pages", """SELECT document_id, section, page_number, CAST(length(seg) AS INT) AS n_chars, md5(seg) AS digest
FROM (SELECT *, CASE WHEN first IS NULL THEN text WHEN length(c) >= 200 THEN c ELSE '' END AS seg FROM cut) s""", PAGES, {**GRP, **_SEGMENTED})
def b15(t):
    s = sectioned(t)
    j = P.group_sections(s).filter("section <> 'notes'").join(s.select("document_id", "page_number", "text"), ["document_id", "page_number"])
    return P.segment_pages(j).select("document_id", "section", "page_number", F.length("segment").alias("n_chars"), F.md5("segment").alias("digest"))


@query("b16_section_text", """SELECT document_id, section, CAST((page_number - 1) // 200 AS INT) AS part_no, count(*) AS n_pages,
  string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page_number) AS text
FROM o_exp e JOIN o_sec s USING (document_id, page_number) GROUP BY ALL""", PAGES, EXP)
def b16(t):
    s = sectioned(t)
    return P.section_text(s, P.expand_continuation(s))


@query("b17_sample_labels", """SELECT document_id, CAST(label_no AS INT) AS label_no, label FROM (
  SELECT document_id, unnest(l) AS label, unnest(range(1, len(l) + 1)) AS label_no FROM (
    SELECT document_id, list_filter(list_transform(string_split(left(body, 6000), chr(10)), lambda x: trim(x)),
             lambda x: length(x) BETWEEN 4 AND 79 AND NOT regexp_matches(x, '^\\d'))[1:30] AS l
    FROM (SELECT document_id, string_agg(text, chr(10) ORDER BY page_number) AS body FROM (
      SELECT document_id, page_number, text, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS rn
      FROM (SELECT DISTINCT document_id, page_number FROM o_exp) JOIN o_sec USING (document_id, page_number)) WHERE rn <= 5
      GROUP BY document_id) t) u) v""", PAGES, EXP)
def b17(t):
    s = sectioned(t)
    return P.sample_labels(s, P.expand_continuation(s))


@query("b18_score_templates", f"""SELECT d.document_id, round(coalesce(b.w / b.total, 0.0), 6) AS score,
  CASE WHEN round(b.w / b.total, 6) >= 0.6 THEN b.template ELSE 'T0_unknown' END AS template_type
FROM (SELECT DISTINCT document_id FROM fx_pages) d LEFT JOIN (
  SELECT h.document_id, template, w, total FROM (
    SELECT document_id, template, sum(weight) AS w, row_number() OVER (PARTITION BY document_id ORDER BY sum(weight) DESC, template) AS rn
    FROM (SELECT document_id, weight, unnest(string_split(hints, ' ')) AS template FROM th) GROUP BY document_id, template) h
  JOIN (SELECT document_id, sum(weight) AS total FROM th GROUP BY document_id) USING (document_id) WHERE rn = 1) b USING (document_id)""",
       PAGES, {"o_signals": _SIGNALS, "th": f"SELECT p.document_id, p.page_number, s.weight, s.hints FROM fx_pages p JOIN o_signals s ON s.hints <> '' AND regexp_matches({NORM.format('p.text')}, s.pattern)"})
def b18(t):
    return P.score_templates(t.pages)

@query("b19_apply_classification", """SELECT document_id,
  CASE WHEN document_id % 3 = 0 THEN company ELSE concat('Group ', document_id) END AS company,
  CASE WHEN document_id % 2 = 0 THEN concat('T', document_id % 8 + 1) ELSE template_type END AS template_type,
  CASE WHEN document_id % 4 = 0 THEN 'fiscal ' || fiscal_year ELSE '' END AS years,
  currency_code, CASE WHEN document_id % 2 = 0 THEN 'millions' ELSE 'units' END AS unit_scale FROM fx_documents""", ("fx_documents",))
def b19(t):
    d = t.documents.withColumns({"report_years": F.array().cast("array<string>"), "unit_scale": F.lit("units")})
    i = F.col("document_id")
    even = i % 2 == 0
    found = t.documents.select(
        "document_id", F.when(i % 3 == 0, "Unknown").otherwise(F.concat(F.lit("Group "), i.cast("string"))).alias("company"),
        F.when(i % 4 == 0, F.array(F.concat(F.lit("fiscal "), F.col("fiscal_year").cast("string")))).otherwise(F.array().cast("array<string>"))
        .alias("report_years"),
        F.when(even, F.concat(F.lit("T"), (i % 8 + 1).cast("string"))).alias("template_type"),
        F.lit(None).cast("string").alias("currency_code"), F.when(even, "millions").alias("unit_scale"))
    return P.apply_classification(d, found).select("document_id", "company", "template_type",
                                                   F.array_join("report_years", ",").alias("years"), "currency_code", "unit_scale")
