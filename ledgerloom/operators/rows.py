"""Row preparation: lines of text, year keys, column types, duplicates, ids, notes, document attributes.

Rows carry an explicit integer order. Values are kept in long form (one row per year); the map form exists
only at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from .ordered import running

# Amounts at the end of a line: 1,234  (1,234)  -1,234.5  and "-" for no value.
AMOUNT = r"\(\d[\d,]*(?:\.\d+)?\)|-?\d[\d,]*(?:\.\d+)?|[-–—]"
LINE_PATTERN = rf"^\s*(.*?)((?:\s+(?:{AMOUNT}))+)\s*$"
#: A line made of years, in a text of lines that end in \\n only.
HEADER_PATTERN = r"(?dm)^[^\d\n]*((19|20)\d{2}\b[^\d\n]*)+$"
#: What \\s stands for, and what `$` lets stand at the end of a line.
BLANKS, LAST = " \t\n\x0b\f\r", "\x85\u2028\u2029"
NOTE_IN_LABEL = r"(?i)\(?\bnote\s+([\d.]+)\)?"
ACCOUNT_CODE = r"^\d{4,}\s+"


def with_value_map(rows: DataFrame, row_values: DataFrame) -> DataFrame:
    """Rows with a raw_values map; a row's years are few."""
    m = row_values.groupBy("document_id", "extraction_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value")))).alias("raw_values"))
    return rows.join(m, ["document_id", "extraction_id"], "left")


def explode_values(df: DataFrame, col: str = "raw_values") -> DataFrame:
    keep = [c for c in df.columns if c != col]
    # Without the outer rows Spark tests the size of the map first, for which it works it out twice.
    return df.select(*keep, F.explode_outer(col).alias("year", "value")).filter("year IS NOT NULL")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once, before any filter on them."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*df.columns, F.inline(F.array(made)).alias(*columns))


def extract_lines(pages: DataFrame) -> DataFrame:
    """Line items of page text, one row per line and year column.

    The first line made of years heads the columns. Labels stay verbatim except for a leading account code;
    amounts in parentheses are negative; a dash is an empty value; two leading blanks are one indentation
    step. Everything happens inside the page's own row.
    """
    p = _once(pages.select("document_id", "page_number", "text"), _head=F.regexp_extract("text", HEADER_PATTERN, 0)).filter("_head <> ''")
    p = p.withColumn("_years", F.regexp_extract_all("_head", F.lit(r"(?:19|20)\d{2}"), F.lit(0)))
    one = p.select("document_id", "page_number", "_years", "_head", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line") != F.col("_head"))
    # One match a line: what stands before the amounts is the label.
    one = _once(one, _tail=F.regexp_extract("line", LINE_PATTERN, 2)).filter("_tail <> ''")
    blanks = F.lit(BLANKS)
    before = F.substring(F.col("line"), F.lit(1), F.length(F.rtrim(F.col("line"), F.lit(BLANKS + LAST))) - F.length("_tail"))
    one = _once(one, _label=F.regexp_replace(F.trim(F.ltrim(before, blanks)), ACCOUNT_CODE, ""), _all=F.regexp_extract_all("_tail", F.lit(AMOUNT), F.lit(0)))
    # Numbers beyond the year columns belong to the label ("Section 3").
    more = F.slice("_all", 1, F.greatest(F.size("_all") - F.size("_years"), F.lit(0)))
    one = _once(one, raw_label=F.trim(F.concat_ws(" ", "_label", F.array_join(more, " "))), _tokens=F.slice(F.reverse("_all"), 1, F.size("_years"))).filter("raw_label <> ''")
    one = one.withColumns({
        "note_ref": F.nullif(F.regexp_extract("raw_label", NOTE_IN_LABEL, 0), F.lit("")), "is_subtotal": F.col("raw_label").rlike(R.TOTAL_LINE),
        "indentation_level": F.floor((F.length("line") - F.length(F.ltrim(F.col("line")))) / 2).cast("int"),
        "_cells": F.arrays_zip(F.reverse(F.slice(F.reverse("_years"), 1, F.size("_tokens"))).alias("year"), F.reverse("_tokens").alias("token"))})
    cols = one.select("document_id", "page_number", (F.col("line_no") + 1).alias("line_no"), "raw_label", "note_ref", "is_subtotal", "indentation_level", F.inline_outer("_cells")).filter("year IS NOT NULL")
    number = F.translate("token", "(),-", "").try_cast("double")
    negative = F.col("token").startswith("(") | (F.col("token").startswith("-") & (F.length("token") > 1))
    return cols.withColumn("value", F.when(negative, -number).otherwise(number)).drop("token")


def classify_columns(headers: DataFrame, col: str = "header") -> DataFrame:
    return headers.withColumns({"column_year": X.header_year(col), "column_type": X.header_type(col)})


def column_metadata(values: DataFrame, unit: list[str], key: str = "year") -> DataFrame:
    """Type and year of every distinct column key of a unit (document, statement, page), in long form."""
    return classify_columns(values.select(*unit, F.col(key).alias("header")).distinct())


def enrich_rows(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows with a label, whole-number indentation and the scope of their statement."""
    r = rows.filter(F.length(F.trim("raw_label")) > 0).withColumn("indentation_level", F.round("indentation_level").cast("int"))
    return r.join(scopes.select("document_id", "statement_type", F.col("scope").alias("statement_scope")),
                  ["document_id", "statement_type"], "left").withColumn("statement_scope", F.coalesce("statement_scope", F.lit("unknown")))


def dedupe_rows(rows: DataFrame, key: list[str], ord_col: str = "ord") -> DataFrame:
    """First of rows that agree on `key`, trimmed label and all values."""
    rest = [c for c in rows.columns if c not in key]
    values = F.to_json(F.array_sort(F.map_entries("raw_values")))
    return (rows.groupBy(*key, F.trim("raw_label").alias("_label"), values.alias("_values"))
            .agg(F.min_by(F.struct(*rest), ord_col).alias("_first")).select(*key, "_first.*").select(*rows.columns))


def stamp_ids(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """extraction_id 1..n per document in order."""
    numbered = running(rows, ["document_id"], ord_col, {"_before": ("sum", F.lit(1))})
    return numbered.withColumn("extraction_id", (F.col("_before") + 1).cast("int")).drop("_before")


def assemble_notes(note_pages: DataFrame, rows: DataFrame, pages: DataFrame, summary_chars: int = 500,
                   max_chars: int | None = None, pages_per_part: int = 200) -> DataFrame:
    """Text of the notes that rows refer to, in page order; long notes continue in further parts."""
    wanted = rows.select("document_id", X.note_number("note_ref").alias("note_number")).filter("note_number IS NOT NULL").distinct()
    np = note_pages.select("document_id", "note_number", "page_number").distinct().join(wanted, ["document_id", "note_number"], "left_semi")
    text = np.join(pages.select("document_id", "page_number", "text"), ["document_id", "page_number"]).filter(F.length(F.trim("text")) > 0)
    part = F.floor((F.col("page_number") - 1) / pages_per_part).cast("int").alias("part_no")
    body = F.expr("listagg(text, '\\n\\n') WITHIN GROUP (ORDER BY page_number)")
    out = text.groupBy("document_id", "note_number", part).agg(F.count(F.lit(1)).alias("n_pages"), body.alias("raw_text"))
    out = out.withColumns({"title": F.concat(F.lit("Note "), F.col("note_number").cast("string")),
                           "summary": F.left("raw_text", F.lit(summary_chars))})
    return out if max_chars is None else out.withColumn("raw_text", F.left("raw_text", F.lit(max_chars)))


def link_notes(notes: DataFrame, rows: DataFrame, note_ord: str = "note_id") -> DataFrame:
    """(document, note, row) links; of notes with the same number the last one is linked."""
    last = notes.groupBy("document_id", "note_number").agg(F.max(note_ord).alias(note_ord))
    refs = rows.select("document_id", "extraction_id", X.note_number("note_ref").alias("note_number")).filter("note_number IS NOT NULL")
    return refs.join(last, ["document_id", "note_number"])


def derive_fiscal_year(documents: DataFrame, row_values: DataFrame) -> DataFrame:
    """Latest year among the value keys, else the first year in the filename."""
    y = row_values.groupBy("document_id").agg(
        F.max(F.nullif(F.regexp_extract("year", r"(19|20)\d{2}", 0), F.lit("")).try_cast("int")).alias("_y"))
    return documents.join(y, "document_id", "left").withColumn(
        "fiscal_year", F.coalesce("_y", X.year_from_filename("filename"))).drop("_y")


def document_scope(rows: DataFrame) -> DataFrame:
    """Most frequent row scope of each document, ties to the lower name."""
    n = rows.groupBy("document_id", "statement_scope").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("document_id").agg(F.min_by("statement_scope", F.struct(-F.col("n"), F.col("statement_scope"))).alias("scope"))


def run_summary(classified: DataFrame, rows: DataFrame, note_pages: DataFrame) -> DataFrame:
    """Per document: pages by class, rows by statement, notes and pages that need OCR."""
    p = classified.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        *[F.count_if(F.col("classification") == k).alias(f"{k}_pages") for k in ("digital", "scanned", "hybrid")],
        F.count_if("requires_ocr").alias("ocr_pages"))
    r = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_rows"),
                                        *[F.count_if(F.col("statement_type") == k).alias(f"{k}_rows") for k in R.STATEMENT_TYPES])
    n = note_pages.select("document_id", "note_number").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("notes"))
    return p.join(r, "document_id", "left").join(n, "document_id", "left").fillna(
        0, ["total_rows", "notes", *[f"{k}_rows" for k in R.STATEMENT_TYPES]])
