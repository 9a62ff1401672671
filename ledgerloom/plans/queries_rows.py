"""Registered row-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from ..operators import pages as P
from ..operators import rows as W
from ..sources import readers
from .catalog import query
from .queries_pages import _SIGNALS, CLS, NORM, PAGES, SEC, classified, sectioned

ROWS, VALUES = ("fx_rows",), ("fx_row_values",)


def payloads(t):
    """One fenced model answer per row, with its values as year_values."""
    v = t.row_values.groupBy("document_id", "extraction_id", "raw_label", "is_subtotal", "indentation_level").agg(
        F.array_sort(F.collect_list(F.struct(F.concat(F.lit("FY "), F.col("year")).alias("year"), "value"))).alias("year_values"))
    body = F.to_json(F.struct(F.array(F.struct("raw_label", "year_values", "is_subtotal", F.col("indentation_level").cast("double")
                                               .alias("indentation_level")),
                                      F.struct(F.lit("  ").alias("raw_label"), "year_values", "is_subtotal",
                                               F.lit(0.0).alias("indentation_level"))).alias("rows")))
    text = F.when(F.col("extraction_id") % 50 == 0, "no answer").otherwise(
        F.concat(F.lit("Here are the rows:\n```json\n"), body, F.lit("\n```")))
    return v.select("document_id", "extraction_id", text.alias("payload"))


@query("a02_parse_row_payloads", """SELECT document_id, extraction_id, raw_label, is_subtotal, indentation_level, year, value
FROM fx_row_values WHERE extraction_id % 50 <> 0""", VALUES)
def a02(t):
    rows = readers.parse_row_payloads(payloads(t))
    return W.explode_values(rows.select("document_id", "extraction_id", "raw_label", "is_subtotal", "indentation_level", "raw_values"))


_RULES = "SELECT * FROM (VALUES " + ", ".join(
    "({}, {}, '{}', '{}', CAST({} AS DOUBLE))".format(o, "NULL" if t is None else f"'{t}'", lab, f, c)
    for o, t, lab, f, c in R.default_rules()) + ") r(rule_ord, template_type, rule_label, canonical_field, rule_confidence)"
N_RULES = len(R.default_rules())


def stored_rules(t):
    """A rule table derived from the part names, half of it inactive."""
    p = t.raw("part")
    return p.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(
        F.col("k").cast("int").alias("rule_ord"), F.when(F.col("k") % 4 == 0, F.lit("T1")).alias("template_type"),
        F.col("p_name").alias("rule_label"), F.lit("other_income").alias("canonical_field"), F.lit(0.8).alias("rule_confidence"),
        (F.col("k") % 2 == 0).alias("active"))


STORED = f"""SELECT CAST(k + {N_RULES} AS INT) AS rule_ord, CASE WHEN k % 4 = 0 THEN 'T1' END AS template_type, p_name AS rule_label,
  'other_income' AS canonical_field, CAST(0.8 AS DOUBLE) AS rule_confidence
FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name) t WHERE k % 2 = 0"""


@query("a03_load_rules", f"SELECT CAST(rule_ord AS INT) AS rule_ord, template_type, rule_label, canonical_field, rule_confidence FROM ({_RULES}) UNION ALL {STORED}")
def a03(t):
    return readers.load_rules(t.spark, stored_rules(t))


@query("a04_derive_coa", f"""SELECT coa_id, line_item_name, statement,
  CASE WHEN regexp_matches(line_item_name, '{R.CONTRA_NAME}') THEN 'contra'
       WHEN statement = 'P&L' AND regexp_matches(line_item_name, '{R.NEGATIVE_NAME}') AND NOT regexp_matches(line_item_name, '{R.POSITIVE_GUARD}')
       THEN 'negative' ELSE 'positive' END AS sign_convention,
  regexp_matches(line_item_name, '{R.SUBTOTAL_NAME}') AS is_subtotal, contains(lower(line_item_name), 'memo') AS is_memo_item
FROM (SELECT CAST(p_partkey AS VARCHAR) AS coa_id, CASE WHEN p_partkey % 2 = 0 THEN 'P&L' ELSE 'Balance Sheet' END AS statement,
  concat(CASE p_partkey % 9 WHEN 0 THEN 'Accumulated Depreciation ' WHEN 1 THEN 'Interest Expense ' WHEN 2 THEN 'Sales Returns '
    WHEN 3 THEN 'Total Income Tax ' WHEN 4 THEN 'Provision for ' WHEN 5 THEN 'Memo ' WHEN 6 THEN 'Dividends ' WHEN 7 THEN 'Net Profit ' ELSE '' END,
    p_name) AS line_item_name FROM part) t""")
def a04(t):
    k = F.col("p_partkey")
    names = ["Accumulated Depreciation ", "Interest Expense ", "Sales Returns ", "Total Income Tax ", "Provision for ", "Memo ",
             "Dividends ", "Net Profit ", ""]
    prefix = F.element_at(F.array(*map(F.lit, names)), (k % 9 + 1).cast("int"))
    entries = t.raw("part").select(k.cast("string").alias("coa_id"), F.concat(prefix, F.col("p_name")).alias("line_item_name"),
                                   F.when(k % 2 == 0, "P&L").otherwise("Balance Sheet").alias("statement"))
    return readers.derive_coa(entries)


@query("c01_extract_lines", """SELECT r.document_id, CAST(r.section_no + CASE r.statement_type WHEN 'balance_sheet' THEN 100 WHEN 'income_statement' THEN 200 WHEN 'cash_flow' THEN 300 ELSE 400 END AS INT) AS page_number,
  r.raw_label, r.is_subtotal, CASE WHEN r.is_subtotal THEN 0 ELSE 1 END AS indentation_level, y.year, CASE WHEN r.extraction_id % 5 = 0 THEN -v.value ELSE v.value END AS value
FROM fx_rows r JOIN (SELECT DISTINCT document_id, statement_type, section_no, year FROM fx_row_values) y USING (document_id, statement_type, section_no)
LEFT JOIN fx_row_values v ON v.document_id = r.document_id AND v.extraction_id = r.extraction_id AND v.year = y.year""", ("fx_rows", "fx_row_values"))
def c01(t):
    """Statement pages rebuilt as text from the line items, one per filing, statement and section, then read again."""
    v = t.row_values
    years = v.select("document_id", "statement_type", "section_no", "year").distinct().groupBy(
        "document_id", "statement_type", "section_no").agg(F.sort_array(F.collect_set("year")).alias("years"))
    amount = F.when(F.col("extraction_id") % 5 == 0, F.concat(F.lit("("), F.format_number("value", 2), F.lit(")"))).otherwise(
        F.format_number("value", 2))
    per = v.groupBy("document_id", "statement_type", "section_no", "extraction_id", "raw_label", "is_subtotal").agg(
        F.map_from_entries(F.collect_list(F.struct("year", amount.alias("a")))).alias("m"))
    j = per.join(years, ["document_id", "statement_type", "section_no"])
    cells = F.array_join(F.transform("years", lambda y: F.coalesce(F.try_element_at("m", y), F.lit("-"))), "  ")
    line = F.concat(F.when(F.col("is_subtotal"), "").otherwise("  "), F.col("raw_label"), F.lit("   "), cells)
    page = j.groupBy("document_id", "statement_type", "section_no", "years").agg(
        F.array_sort(F.collect_list(F.struct("extraction_id", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("Particulars  "), F.array_join("years", "  "), F.lit("\n"), F.array_join(F.col("l.line"), "\n"))
    pages = page.select("document_id", (F.col("section_no") + F.when(F.col("statement_type") == "balance_sheet", 100)
                                        .when(F.col("statement_type") == "income_statement", 200)
                                        .when(F.col("statement_type") == "cash_flow", 300).otherwise(400)).alias("page_number"),
                        text.alias("text"))
    return W.extract_lines(pages).select("document_id", "page_number", "raw_label", "is_subtotal", "indentation_level", "year", "value")


_KEY = """CASE extraction_id % 4 WHEN 0 THEN year WHEN 1 THEN concat('FY ', CAST(CAST(year AS INT) - 1 AS VARCHAR), '-', right(year, 2))
 WHEN 2 THEN concat('Year ended ', year) ELSE 'no year here' END"""


def raw_keys(t):
    e, y = F.col("extraction_id") % 4, F.col("year")
    fiscal = F.concat(F.lit("FY "), (y.cast("int") - 1).cast("string"), F.lit("-"), F.right(y, F.lit(2)))
    return t.row_values.withColumn("key", F.when(e == 0, y).when(e == 1, fiscal).when(e == 2, F.concat(F.lit("Year ended "), y))
                                   .otherwise("no year here"))


@query("c02_year_key", f"""SELECT document_id, extraction_id, k AS key,
  CASE WHEN regexp_matches(trim(k), '(\\d{{4}})-(\\d{{2}})$')
       THEN CAST(CAST(regexp_extract(trim(k), '(\\d{{4}})-(\\d{{2}})$', 1) AS INT) // 100 * 100 + CAST(regexp_extract(trim(k), '(\\d{{4}})-(\\d{{2}})$', 2) AS INT) AS VARCHAR)
       WHEN len(regexp_extract_all(k, '\\d{{4}}')) > 0 THEN regexp_extract_all(k, '\\d{{4}}')[-1] ELSE k END AS year_key
FROM (SELECT document_id, extraction_id, {_KEY} AS k FROM fx_row_values) t""", VALUES)
def c02(t):
    return raw_keys(t).select("document_id", "extraction_id", "key", X.year_key("key").alias("year_key"))


_HEAD = """CASE extraction_id % 5 WHEN 0 THEN year WHEN 1 THEN concat('Restated ', year) WHEN 2 THEN concat('Budget FY', year)
 WHEN 3 THEN concat(year, ' projected') ELSE 'Notes' END"""
_TYPE = "CASE WHEN regexp_matches(h, '(?i)(restated|re-stated|revised|as\\s+restated)') THEN 'restated' WHEN regexp_matches(h, '(?i)(budget|budgeted)') THEN 'budget' WHEN regexp_matches(h, '(?i)(forecast|projected|estimate)') THEN 'forecast' ELSE 'actual' END"
_YEAR = "CAST(coalesce(nullif(regexp_extract(h, '20\\d{2}|19\\d{2}', 0), ''), '0') AS INT)"


def raw_headers(t):
    e, y = F.col("extraction_id") % 5, F.col("year")
    return t.row_values.withColumn("header", F.when(e == 0, y).when(e == 1, F.concat(F.lit("Restated "), y))
                                   .when(e == 2, F.concat(F.lit("Budget FY"), y)).when(e == 3, F.concat(y, F.lit(" projected"))).otherwise("Notes"))


@query("c03_classify_columns", f"""SELECT document_id, extraction_id, h AS header, {_YEAR} AS column_year, {_TYPE} AS column_type
FROM (SELECT *, {_HEAD} AS h FROM fx_row_values) t""", VALUES)
def c03(t):
    return W.classify_columns(raw_headers(t)).select("document_id", "extraction_id", "header", "column_year", "column_type")


@query("c04_column_metadata", f"""SELECT DISTINCT document_id, statement_type, section_no, h AS header, {_YEAR} AS column_year, {_TYPE} AS column_type
FROM (SELECT *, {_HEAD} AS h FROM fx_row_values) t""", VALUES)
def c04(t):
    return W.column_metadata(raw_headers(t), ["document_id", "statement_type", "section_no"], "header")


def scopes(t):
    """A scope per filing and statement."""
    slot = (F.col("document_id") + F.length("statement_type")) % 3
    return t.rows.select("document_id", "statement_type").distinct().filter(slot != 2).withColumn(
        "scope", F.when(slot == 0, "consolidated").otherwise("standalone"))


SCOPED = """SELECT *, CASE (document_id + length(statement_type)) % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'standalone' ELSE 'unknown' END
 AS statement_scope FROM fx_rows"""


def scoped_rows(t):
    return W.enrich_rows(t.rows, scopes(t))


@query("c05_enrich_rows", """SELECT document_id, extraction_id, raw_label, CAST(round(indentation_level + 0.4) AS INT) AS indentation_level,
  statement_type, statement_scope FROM sr WHERE extraction_id % 10 <> 0""", ROWS, {"sr": SCOPED})
def c05(t):
    raw = t.rows.withColumns({"indentation_level": F.col("indentation_level") + 0.4,
                              "raw_label": F.when(F.col("extraction_id") % 10 == 0, "  ").otherwise(F.col("raw_label"))})
    return W.enrich_rows(raw, scopes(t)).select("document_id", "extraction_id", "raw_label", "indentation_level", "statement_type", "statement_scope")


def with_copies(t):
    """Rows with values; every third row occurs again later in the document with blanks around its label."""
    wide = W.with_value_map(t.rows, t.row_values).withColumn("ord", F.col("extraction_id").cast("bigint") * 2)
    again = wide.filter("extraction_id % 3 = 0").withColumns({"ord": F.col("ord") + 1_000_001, "raw_label": F.concat(F.lit(" "), F.col("raw_label"), F.lit(" "))})
    return wide.unionByName(again).drop("extraction_id")


DEDUPE_KEY = ["document_id", "statement_type", "section_no", "indentation_level"]


@query("c06_dedupe_rows", "SELECT document_id, statement_type, section_no, raw_label, is_subtotal, CAST(extraction_id AS BIGINT) * 2 AS ord FROM fx_rows", ROWS)
def c06(t):
    return W.dedupe_rows(with_copies(t), DEDUPE_KEY).select("document_id", "statement_type", "section_no", "raw_label", "is_subtotal", "ord")


@query("c07_stamp_ids", "SELECT document_id, extraction_id, statement_type, raw_label FROM fx_rows", ROWS)
def c07(t):
    return W.stamp_ids(W.dedupe_rows(with_copies(t), DEDUPE_KEY)).select("document_id", "extraction_id", "statement_type", "raw_label")


@query("c08_note_number", "SELECT row_id, raw_label, TRY_CAST(nullif(regexp_extract(raw_label, '\\d+', 0), '') AS INT) AS note_number FROM fx_labels", ("fx_labels",))
def c08(t):
    return t.labels.select("row_id", "raw_label", X.note_number("raw_label").alias("note_number"))


def noted_rows(t):
    e = F.col("extraction_id")
    return t.rows.withColumn("note_ref", F.when(e % 3 == 0, F.concat(F.lit("Note "), (e % 12 + 1).cast("string"), F.lit(".1"))))


NOTED = "SELECT *, CASE WHEN extraction_id % 3 = 0 THEN CAST(extraction_id % 12 + 1 AS INT) END AS note_number FROM fx_rows"
NOTE_PAGES = """SELECT document_id, TRY_CAST(regexp_extract(text, '(?im)^note\\s+(\\d+)', 1) AS INT) AS note_number, page_number, text
FROM o_sec WHERE cls <> 'scanned' AND regexp_matches(text, '(?im)^note\\s+\\d+') AND 'notes' IN (section_type, coalesce(secondary_section_type, ''))"""


@query("c09_assemble_notes", """SELECT document_id, note_number, CAST((page_number - 1) // 200 AS INT) AS part_no, count(*) AS n_pages,
  concat('Note ', note_number) AS title, left(string_agg(text, chr(10) || chr(10) ORDER BY page_number), 500) AS summary,
  string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS raw_text
FROM np WHERE (document_id, note_number) IN (SELECT (document_id, note_number) FROM nr WHERE note_number IS NOT NULL) GROUP BY ALL""",
       ("fx_pages", "fx_rows"), {**SEC, "nr": NOTED, "np": NOTE_PAGES})
def c09(t):
    s = sectioned(t)
    return W.assemble_notes(P.note_pages(s), noted_rows(t), s)


@query("c10_link_notes", """SELECT r.document_id, r.note_number, r.extraction_id, n.note_id FROM nr r
JOIN (SELECT document_id, note_number, max(page_number) AS note_id FROM np GROUP BY ALL) n USING (document_id, note_number)""",
       ("fx_pages", "fx_rows"), {**SEC, "nr": NOTED, "np": NOTE_PAGES})
def c10(t):
    notes = P.note_pages(sectioned(t)).withColumnRenamed("page_number", "note_id")
    return W.link_notes(notes, noted_rows(t))


@query("c11_derive_company", "SELECT document_id, filename, replace(company, '_', ' ') AS company FROM fx_documents", ("fx_documents",))
def c11(t):
    return t.documents.select("document_id", "filename", X.company_from_filename("filename").alias("company"))


@query("c12_derive_fiscal_year", """SELECT d.document_id, coalesce(v.y, d.fiscal_year) AS fiscal_year FROM fx_documents d
LEFT JOIN (SELECT document_id, max(CAST(year AS INT)) AS y FROM fx_values GROUP BY document_id) v USING (document_id)""", ("fx_documents", "fx_values"))
def c12(t):
    return W.derive_fiscal_year(t.documents, t.row_values).select("document_id", "fiscal_year")


@query("c13_document_scope", """SELECT document_id, statement_scope AS scope FROM (
  SELECT document_id, statement_scope, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, statement_scope) AS rn
  FROM sr GROUP BY document_id, statement_scope) t WHERE rn = 1""", ROWS, {"sr": SCOPED})
def c13(t):
    return W.document_scope(scoped_rows(t))


@query("c14_run_summary", """SELECT p.*, coalesce(total_rows, 0) AS total_rows, coalesce(bs, 0) AS balance_sheet_rows, coalesce(inc, 0) AS income_statement_rows,
  coalesce(cf, 0) AS cash_flow_rows, coalesce(eq, 0) AS equity_statement_rows, coalesce(n.notes, 0) AS notes
FROM (SELECT document_id, count(*) AS total_pages, count(*) FILTER (cls = 'digital') AS digital_pages, count(*) FILTER (cls = 'scanned') AS scanned_pages,
        count(*) FILTER (cls = 'hybrid') AS hybrid_pages, count(*) FILTER (cls = 'scanned') AS ocr_pages FROM o_class GROUP BY document_id) p
LEFT JOIN (SELECT document_id, count(*) AS total_rows, count(*) FILTER (statement_type = 'balance_sheet') AS bs, count(*) FILTER (statement_type = 'income_statement') AS inc,
  count(*) FILTER (statement_type = 'cash_flow') AS cf, count(*) FILTER (statement_type = 'equity_statement') AS eq FROM fx_rows GROUP BY document_id) r USING (document_id)
LEFT JOIN (SELECT document_id, count(DISTINCT note_number) AS notes FROM np GROUP BY document_id) n USING (document_id)""",
       ("fx_pages", "fx_rows"), {**SEC, "np": NOTE_PAGES})
def c14(t):
    s = sectioned(t)
    return W.run_summary(classified(t), t.rows, P.note_pages(s))


#: Rules of the built-in list, and the words that every document's second page begins with as labels of its template.
_PAGE_RULES = f"""SELECT template_type, rule_label FROM ({_RULES}) r UNION ALL
SELECT concat('T', document_id % 8 + 1), regexp_extract(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '^[a-z0-9]+ [a-z0-9]+') FROM fx_pages WHERE page_number = 2"""


def page_rules(t):
    words = F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " "))
    own = t.pages.filter("page_number = 2").select(F.lit(0).alias("rule_ord"), F.concat(F.lit("T"), (F.col("document_id") % 8 + 1).cast("string")).alias("template_type"), F.regexp_extract(words, r"^[a-z0-9]+ [a-z0-9]+", 0).alias("rule_label"),
                                                  F.lit("other_income").alias("canonical_field"), F.lit(0.8).alias("rule_confidence"))
    return readers.load_rules(t.spark).unionByName(own)


_LABELLED = {
    "o_signals": _SIGNALS,
    "page_rule": _PAGE_RULES,
    "phrase": """SELECT rule_label AS label, string_split(rule_label, ' ') AS words, list_sort(list(DISTINCT template_type)) AS templates
FROM page_rule WHERE template_type IS NOT NULL AND rule_label <> '' GROUP BY rule_label
HAVING count(DISTINCT template_type) < (SELECT count(DISTINCT template_type) FROM page_rule WHERE rule_label <> '')""",
    "token": """SELECT document_id, page_number, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM (
  SELECT document_id, page_number, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS tokens FROM fx_pages) t""",
    "met": """SELECT DISTINCT document_id, label, templates FROM (
  SELECT t.document_id, t.page_number, t.i, arg_max(p.label, len(p.words)) AS label, arg_max(p.templates, len(p.words)) AS templates
  FROM token t JOIN phrase p ON t.tokens[t.i] = p.words[1] AND t.tokens[t.i:t.i + len(p.words) - 1] = p.words GROUP BY t.document_id, t.page_number, t.i) m""",
    "th": f"""SELECT p.document_id, s.weight, string_split(s.hints, ' ') AS hints FROM fx_pages p JOIN o_signals s ON s.hints <> '' AND regexp_matches({NORM.format('p.text')}, s.pattern)
UNION ALL SELECT document_id, CAST(0.2 AS DOUBLE), templates FROM met""",
}


@query("b18_label_hits", "SELECT document_id, label, array_to_string(templates, ' ') AS templates FROM met", PAGES, _LABELLED)
def b18b(t):
    return P.label_hits(t.pages, P.label_phrases(page_rules(t))).select("document_id", "label", F.array_join("templates", " ").alias("templates"))


@query("b18_templates_with_labels", """SELECT d.document_id, round(coalesce(b.w / b.total, 0.0), 6) AS score, CASE WHEN round(b.w / b.total, 6) >= 0.6 THEN b.template ELSE 'T0_unknown' END AS template_type
FROM (SELECT DISTINCT document_id FROM fx_pages) d LEFT JOIN (
  SELECT h.document_id, template, w, total FROM (
    SELECT document_id, template, sum(weight) AS w, row_number() OVER (PARTITION BY document_id ORDER BY round(sum(weight), 6) DESC, template) AS rn
    FROM (SELECT document_id, weight, unnest(hints) AS template FROM th) GROUP BY document_id, template) h
  JOIN (SELECT document_id, sum(weight) AS total FROM th GROUP BY document_id) USING (document_id) WHERE rn = 1) b USING (document_id)""", PAGES, _LABELLED)
def b18c(t):
    return P.score_templates(t.pages, rules=page_rules(t))
