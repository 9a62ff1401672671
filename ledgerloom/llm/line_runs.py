"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys, hashed to 128 bits, with the number of documents seen and the largest doc_id among
them, bucketed and sorted by hash. A batch of documents is reduced to one row for each of its keys, anti-joined with
every run by merging (a key that a run shows in enough documents, with an owner as large, has nothing to add), and
what is left becomes a run of the lowest level. A level that is full is compacted into one run of the next. Because
runs and batches are partitioned alike, neither a join nor a compaction exchanges a run. At the end one merge of all
runs names the repeated lines and their owners; all other documents lose them. DataFrame functions only.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import materialise, tune, work_dir

#: Code points of a key that counts, and documents it has to be found in.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches that a whole table is dealt into, and runs of a level that are compacted into one.
BATCHES, FANOUT = 6, 2
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The text split at line ends; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def entries(docs: DataFrame, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """(batch, h1, h2, doc_id, text_hash, line): every line whose key is long enough, numbered from 0 in its text.

    Batches go by descending doc_id, so that a key is settled by its largest ids and later batches add nothing to it.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], F.lit(1000))).first()[0] or [] if batches > 1 else []
    batch = F.lit(len(cuts))
    for k, cut in enumerate(cuts):  # the largest cut decides first
        batch = F.when(F.col("doc_id") >= cut, len(cuts) - 1 - k).otherwise(batch)
    rows = docs.select(batch.alias("batch"), "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("line", "value"))
    rows = rows.where(F.length("value") >= least_chars).withColumn("value", F.btrim("value", F.lit(SPACE))).where(F.length("value") >= least_chars)
    key = F.translate("value", UPPER, LOWER)
    return rows.select("batch", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "doc_id", "text_hash", "line")


def seen(lines: DataFrame) -> DataFrame:
    """(h1, h2, docs, owner): one row for each key of a batch, with its documents and the largest doc_id."""
    return lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("owner"))


class Runs:
    """Levelled sorted runs of line keys in the shared work folder.

    The documents of a batch must not come again in another one; the order of batches changes what is stored, but
    no result. `close` takes the runs out of the catalogue.
    """

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def add(self, batch: DataFrame) -> None:
        """Anti-join a batch (h1, h2, docs, owner) with the runs and keep what is new as a run of its own."""
        new = batch.alias("b")
        for name in (n for level in self.levels for n in level):
            run = self.spark.table(name).alias("r").hint("merge")
            settled = (F.col("r.docs") >= self.least_docs) & (F.col("r.owner") >= F.col("b.owner"))
            new = new.join(run, (F.col("b.h1") == F.col("r.h1")) & (F.col("b.h2") == F.col("r.h2")) & settled, "left_anti").alias("b")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merge(full), level + 1)
            self._forget(full)
            level += 1

    def merged(self) -> DataFrame:
        """(h1, h2, docs, owner) of every key, in one row; `docs` is exact below least_docs and at least that from there on."""
        return self._merge([n for level in self.levels for n in level])  # small runs first

    def close(self) -> None:
        self._forget([n for level in self.levels for n in level])
        self.levels = [[]]

    def _merge(self, names: list[str]) -> DataFrame:
        """The runs as one. Two are merged in place; more exchange what has been merged before the next one."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            # Not a union: its partitioning is not to be relied on when bucketed scans are turned off behind it.
            a, b = rows.alias("a"), self.spark.table(name).alias("b").hint("merge")
            both = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
            docs = (F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))).alias("docs")
            rows = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer").select(both("h1"), both("h2"), docs, F.greatest("a.owner", "b.owner").alias("owner"))
        return rows

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        with sorted_buckets(self.spark):
            rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", os.path.join(work_dir(self.spark), name)).format("parquet").saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Let scans of one-file buckets keep their order, so that merging needs no sort."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def repeated(lines: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2, owner) of the keys found in `least_docs` documents at least, from `entries` written by batch.

    All rows of a doc_id are one document; those without one are one, the smallest.
    """
    runs = Runs(lines.sparkSession, least_docs, fanout)
    try:
        for k in range(batches):
            runs.add(seen(lines.where(F.col("batch") == k)))
        return materialise(runs.merged().where(F.col("docs") >= least_docs).select("h1", "h2", "owner"))
    finally:
        runs.close()


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """`docs` with the lines left in text, and n_lines and n_dropped: columns of those names are replaced.

    `docs` has doc_id (whole numbers) and text. Lines are split at \\n; null and empty texts are one empty line. A
    line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least `least_chars`
    code points found in at least `least_docs` documents lose all their lines except in the largest doc_id that holds
    them, which keeps all of them. `n_lines` counts lines before dropping; a text that loses none keeps its bytes (null
    becomes empty). Rows of one doc_id are one document, rows without one are one that is smaller than all others. No
    rows give no rows.
    """
    tune(docs.sparkSession)
    lines = materialise(entries(docs, least_chars, batches), partition_by=("batch",))
    owners = repeated(lines, least_docs, batches, fanout)
    lost = lines.join(owners, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    lost = materialise(lost.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("__lost")))
    lost = lost.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__lost")
    found = docs.drop("n_lines", "n_dropped").withColumn("__text_hash", F.xxhash64("text"))
    found = found.join(lost, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left").drop("__id", "__hash", "__text_hash")
    lost_lines = F.col("__lost")

    def stretch(end: Column, k: Column, all_lines: Column) -> Column:
        """The lines between one dropped line and the next."""
        start = F.when(k == 0, 0).otherwise(F.coalesce(F.get(lost_lines, k - 1), F.lit(-1)) + 1)
        return F.slice(all_lines, start + 1, end - start)

    kept = lambda all_lines: F.array_join(F.flatten(F.transform(F.concat(lost_lines, F.array(F.size(all_lines))), lambda end, k: stretch(end, k, all_lines))), "\n")
    text = F.when(lost_lines.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.get(F.transform(F.array(lines_of(F.col("text"))), kept), F.lit(0)))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    count = F.length(F.coalesce("text", F.lit(""))) - F.length(F.translate(F.coalesce("text", F.lit("")), "\n", "")) + 1
    return found.select(*(text.alias(c) if c == "text" else F.col(c) for c in names), count.cast("long").alias("n_lines"), F.coalesce(F.size(lost_lines), F.lit(0)).cast("long").alias("n_dropped"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    return drop_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key
  HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {LEAST_DOCS})
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key AND k.doc_id IS DISTINCT FROM f.owner
GROUP BY k.r, k.doc_id"""
