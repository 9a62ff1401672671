"""Input tables: page text, model row payloads, rules, chart of accounts, corpus folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X

PAGE_SCHEMA = "document_id string, page_number int, text string, drawing_count int"
ROW_PAYLOAD = ("struct<rows:array<struct<raw_label:string,year_values:array<struct<year:string,value:double>>,"
               "section_path:array<string>,indentation_level:double,is_subtotal:boolean,note_ref:string>>>")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "document_id", text_col: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """One row per page. Text is a string column, or an array of pages that is numbered from 1.

    Formats: parquet, orc, json, csv (with the page schema), text (one file per document, pages split at
    form feeds).
    """
    if fmt == "text":
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document_id"),
                                                             F.split("value", "\f").alias("text"))
        keep = []
    else:
        reader = spark.read.format(fmt)
        if fmt in ("json", "csv"):
            reader = reader.schema(PAGE_SCHEMA).option("header", "true").option("multiLine", str(fmt == "csv").lower())
        src = reader.load(path)
        extra = [c for c in ("page_number", "drawing_count") if c in src.columns]
        whole = src.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"), *extra, *(keep or []))
    if dict(whole.dtypes)["text"].startswith("array"):
        rest = [c for c in whole.columns if c not in ("text", "page_number")]
        return whole.select(*rest, F.posexplode("text").alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)
    return whole


def parse_row_payloads(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Rows of model answers: code fences off, outermost braces, blank labels out; unreadable answers give no rows.

    Every other column of `payloads` is kept; `ord` is the row's place in the answer.
    """
    keep = [c for c in payloads.columns if c != col]
    # Steps of their own, so that each expression is worked out once for an answer.
    text = payloads.select(*keep, F.trim(F.regexp_replace(F.col(col), r"```json|```", "")).alias("_clean"))
    text = text.select(*keep, "_clean", F.instr("_clean", "{").alias("_start"), (F.length("_clean") - F.instr(F.reverse("_clean"), "}") + 1).alias("_end"))
    start, end = F.col("_start"), F.col("_end")
    body = F.when((start > 0) & (end >= start), F.substring(F.col("_clean"), start, end - start + 1)).otherwise(F.col("_clean"))
    rows = text.select(*keep, F.posexplode(F.from_json(body, ROW_PAYLOAD)["rows"]).alias("ord", "row"))
    values = F.map_from_entries(F.transform(F.coalesce("row.year_values", F.array()),
                                            lambda y: F.struct(X.year_key(F.coalesce(y["year"], F.lit(""))), y["value"])))
    return rows.select(*keep, (F.col("ord") + 1).alias("ord"), F.trim("row.raw_label").alias("raw_label"), values.alias("raw_values"),
                       F.coalesce("row.section_path", F.array().cast("array<string>")).alias("section_path"),
                       F.coalesce(F.round("row.indentation_level").cast("int"), F.lit(0)).alias("indentation_level"),
                       F.coalesce("row.is_subtotal", F.lit(False)).alias("is_subtotal"), F.col("row.note_ref").alias("note_ref")
                       ).filter(F.length("raw_label") > 0)


def load_rules(spark: SparkSession, stored: DataFrame | None = None) -> DataFrame:
    """Rules in order: the built-in list, then the active rows of a stored rule table."""
    base = R.rules_frame(spark)
    if stored is None:
        return base
    first = len(R.default_rules())
    active = stored.filter("active").select((F.col("rule_ord") + first).cast("int").alias("rule_ord"), "template_type", "rule_label",
                                            "canonical_field", "rule_confidence")
    return base.unionByName(active)


def derive_coa(entries: DataFrame) -> DataFrame:
    """Sign convention, subtotal and memo flags of a chart of accounts, from its names."""
    name = F.trim("line_item_name")
    return entries.filter(F.length(F.trim("coa_id")) > 0).withColumns({
        "coa_id": F.trim("coa_id"), "line_item_name": name, "sign_convention": X.sign_convention(name, "statement"),
        "is_subtotal": X.is_subtotal_name(name), "is_memo_item": X.is_memo_name(name)})


def ingest(incoming: DataFrame, loaded: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of documents that are not loaded yet."""
    return incoming.join(loaded.select(key).distinct(), key, "left_anti")
