"""Taking in a folder of page files: what is new, what each file gave, and what is remembered of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

LEDGER = "path string, length long, modified timestamp"
SCHEMA = "document_id long, page_number int, text string"
BAD = "_corrupt_record"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the files below a folder; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


def ingest_folder(spark: SparkSession, folder: str, ledger: DataFrame | None = None, loaded: DataFrame | None = None, schema: str = SCHEMA) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to load, one outcome for each file, the ledger afterwards) of the JSON-lines files below a folder.

    A file of the same path, length and modification time as one in `ledger` is `seen` and not read. Lines that do not
    parse, or without a document_id, are bad and counted. A document in `loaded`, or in a file earlier by path, is not
    loaded again. Outcomes: seen, empty (blank lines only; files of no bytes are not listed), failed (all lines bad), repeated (nothing new), partial (some
    lines bad), loaded; with n_lines, n_bad and n_rows, the rows to load. Files that fail are in the ledger like all
    others: they come again once they change.
    """
    files = materialise(list_files(spark, folder).withColumn("file_no", F.monotonically_increasing_id()))
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger.select("path", "length", "modified")
    key = ["path", "length", "modified"]
    new = files.join(ledger.distinct(), key, "left_anti")
    paths = [r.path for r in new.select("path").orderBy("path").collect()]  # as many as Spark's own listing holds
    empty = spark.createDataFrame([], schema).withColumns({BAD: F.lit(None).cast("string"), "path": F.lit(None).cast("string")})
    if paths:
        names = [f.name for f in empty.schema.fields if f.name not in (BAD, "path")]
        read = spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(paths)
        lines = materialise(read.select(*names, BAD, F.url_decode(F.col("_metadata.file_path")).alias("path")))
    else:
        lines = empty
    bad = F.col(BAD).isNotNull() | F.col("document_id").isNull()
    good = lines.filter(~bad).drop(BAD)
    # The first file of a document has it; `loaded` comes before all files.
    first = good.groupBy("document_id").agg(F.min("path").alias("path"))
    if loaded is not None:
        first = first.join(loaded.select("document_id").distinct(), "document_id", "left_anti")
    rows = good.join(first, ["document_id", "path"], "left_semi")
    counted = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_bad"))
    fresh = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))
    names = new.select("path", F.url_decode("path").alias("_plain")).withColumn("_new", F.lit(True))
    out = files.drop("file_no").join(names, "path", "left").join(counted.withColumnRenamed("path", "_plain"), "_plain", "left").join(fresh.withColumnRenamed("path", "_plain"), "_plain", "left")
    out = out.fillna({"n_lines": 0, "n_bad": 0, "n_rows": 0})
    status = (F.when(F.col("_new").isNull(), "seen").when(F.col("n_lines") == 0, "empty").when(F.col("n_bad") == F.col("n_lines"), "failed")
              .when(F.col("n_rows") == 0, "repeated").when(F.col("n_bad") > 0, "partial").otherwise("loaded"))
    outcomes = out.select(*key, status.alias("status"), "n_lines", "n_bad", "n_rows")
    return rows.drop("path"), outcomes, ledger.unionByName(new.select(*key)).distinct()
