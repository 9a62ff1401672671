"""Output: JSON documents in parts of bounded size, raw rows, report frames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..operators.ordered import part_no
from ..operators.views import tier_filter
from ..session import work_dir

ROWS_PER_PART = 10_000


def export_json(documents: DataFrame, mapped: DataFrame, checks: DataFrame, tier: str = "canonical", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Documents as JSON: meta, validation, and rows in five statement buckets (unknown types go to other).

    A document of up to `rows_per_part` rows is one JSON value; longer ones continue in further parts.
    `mapped` carries extraction_id, statement_type and the columns to be exported.
    """
    m = tier_filter(mapped, tier)
    bucket = F.when(F.col("statement_type").isin(R.STATEMENT_TYPES), F.col("statement_type")).otherwise("other")
    item = F.struct(*[c for c in m.columns if c not in ("document_id", "statement_type", "template_type")])
    ordered = F.struct(F.col("extraction_id").alias("_o"), item.alias("row"))
    names = [*R.STATEMENT_TYPES, "other"]
    rows = m.withColumn("_bucket", bucket).groupBy("document_id", part_no("extraction_id", rows_per_part).alias("part_no")).agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("_bucket") == n, ordered)), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)),
                      lambda x: x["row"]).alias(n) for n in names])
    v = checks.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "check_id", F.struct("status", "name", "lhs", "rhs", "diff_pct")))).alias("validation"))
    meta = F.struct(*[c for c in documents.columns], F.lit(tier).alias("tier"))
    d = documents.select("document_id", meta.alias("meta"))
    j = rows.join(d, "document_id").join(v, "document_id", "left")
    return j.select("document_id", "part_no", F.to_json(F.struct("meta", "validation", F.struct(*names).alias("statements"))).alias("json"))


def export_raw_json(rows: DataFrame, row_values: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Extracted rows unmodified, in order, one JSON value per document part."""
    v = row_values.groupBy("document_id", "extraction_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value")))).alias("raw_values"))
    j = rows.join(v, ["document_id", "extraction_id"], "left")
    first = ["extraction_id", *[c for c in j.columns if c not in ("document_id", "extraction_id", "raw_values")]]
    keyed = F.struct(F.col("extraction_id").alias("_o"), F.struct(*first, "raw_values").alias("row"))
    part = part_no("extraction_id", rows_per_part)
    lst = F.array_sort(F.collect_list(keyed), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0))
    out = j.groupBy("document_id", part.alias("part_no")).agg(F.transform(lst, lambda x: x["row"]).alias("rows"))
    return out.select("document_id", "part_no", F.to_json(F.struct("document_id", "part_no", "rows")).alias("json"))


def write_json(exported: DataFrame, path: str) -> None:
    """One line of JSON per document part."""
    exported.select("json").write.mode("overwrite").text(path)


def write_report(frames: dict[str, DataFrame], path: str | None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Report frames below one folder, a folder per sheet; returns them as written."""
    out = {}
    for sheet, df in frames.items():
        spark = df.sparkSession
        target = os.path.join(path or work_dir(spark), "report", f"sheet={sheet}")
        df.write.mode("overwrite").option("header", "true").format(fmt).save(target)
        out[sheet] = spark.read.schema(df.schema).option("header", "true").format(fmt).load(target)
    return out
