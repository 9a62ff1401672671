"""Sharding by extendible hashing: a directory over hash-prefix bits, of which only oversized buckets split.

A bucket of depth d holds the rows whose hash begins with its d bits. It splits on the next bit while its texts
exceed the byte limit and its hashes differ. Sizes come from one grouped sum over hash prefixes a few bits finer
than the shards; only prefixes that are still too large are summed again, some bits deeper. The directory names
the bucket of every prefix; rows look theirs up. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import materialise, tune

#: Text bytes in a shard, at most.
SHARD_BYTES = 64 << 20
#: Hash bits; bits summed beyond those that even buckets would need, and beyond an oversized prefix.
BITS, FINER, DEEPER = 60, 3, 6


def _hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the row's id and text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The buckets of rows (h, n_bytes) by hash cell, and the bits of a cell.

    (cell, buckets): each bucket with depth, prefix, rows, bytes and `same`, which marks rows of one hash that
    exceed the limit together.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + FINER))
    at = lambda depth: F.expr(f"shiftright(h, {BITS - depth})")

    def sums(part: DataFrame, low: int, high: int) -> DataFrame:
        """Buckets of all depths from low to high, from one sum at the deepest."""
        cells = part.groupBy(at(high).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = cells.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "*").withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        return levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    splits = (F.col("n_bytes") > limit) & (F.col("lo") < F.col("hi"))
    found, depth, part, leaves = bits, 0, rows, None
    while True:
        level = materialise(sums(part, depth, found).withColumn("splits", splits))
        parent = level.where("splits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        leaf = level.where("NOT splits").withColumn("above", F.expr("shiftright(prefix, 1)")).join(parent, ["depth", "above"], "left_semi").drop("above")
        if not depth:  # the root has no parent; all others need one that splits
            leaf = level.where("NOT splits AND depth = 0").unionByName(leaf)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        over = level.where(F.col("splits") & (F.col("depth") == found)).select(F.col("prefix").alias("p"))
        if found >= BITS or not over.take(1):
            break
        part = rows.join(over, at(found) == F.col("p"), "left_semi")
        depth, found = found, min(BITS, found + DEEPER)
    bucket = F.struct("depth", "prefix", "n", "n_bytes", (F.col("n_bytes") > limit).alias("same")).alias("bucket")
    first = F.expr(f"CASE WHEN depth <= {bits} THEN shiftleft(prefix, {bits} - depth) ELSE shiftright(prefix, depth - {bits}) END")
    last = F.expr(f"CASE WHEN depth <= {bits} THEN shiftleft(prefix + 1, {bits} - depth) - 1 ELSE shiftright(prefix, depth - {bits}) END")
    cells = leaves.select(bucket, F.explode(F.sequence(first, last)).alias("cell")).groupBy("cell").agg(F.collect_list("bucket").alias("buckets"))
    return materialise(cells), bits


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """`docs` with shard, part, depth and n_bytes: columns of those names are replaced.

    `shard` is the bucket's bits, '' for the root; `n_bytes` the text's UTF-8 bytes (null: 0). Every shard holds at
    most `limit` bytes, except one that a single larger text has to itself. Rows equal in id and text have one hash:
    where they exceed the limit together, `part` deals them out, otherwise it is 0. No rows give no rows.
    """
    tune(docs.sparkSession)
    hashed = docs.drop("shard", "part", "depth", "n_bytes").withColumns({"h": _hash(F.col("doc_id"), F.col("text")), "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    cells, bits = directory(hashed.select("h", "n_bytes"), limit)
    own = F.expr(f"filter(buckets, b -> b.prefix = shiftright(h, {BITS} - b.depth))[0]")
    placed = hashed.withColumn("cell", F.expr(f"shiftright(h, {BITS - bits})")).join(cells, "cell").withColumn("bucket", own).drop("buckets", "cell")
    shard_bits = F.when(F.col("bucket.depth") == 0, "").otherwise(F.expr("lpad(bin(bucket.prefix), bucket.depth, '0')"))
    names = [c for c in hashed.columns if c not in ("h", "n_bytes")]
    out = lambda df, part: df.select(*names, shard_bits.alias("shard"), part.cast("long").alias("part"), F.col("bucket.depth").alias("depth"), "n_bytes")
    if not cells.where(F.exists("buckets", lambda b: b["same"] & (b["n"] > 1))).take(1):
        return out(placed, F.lit(0))
    # Equal rows are numbered by the partition they were read in, and from the partitions' counts before it. They are
    # written with it, so that both sides of the join below see the same partitions.
    equal = materialise(placed.where("bucket.same AND bucket.n > 1").withColumn("at", F.spark_partition_id()))
    before = equal.groupBy("h", "at").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy("h").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    numbered = equal.withColumn("number", F.row_number().over(W.partitionBy("h", "at").orderBy("n_bytes")) - 1).join(before, ["h", "at"])
    return out(placed.where("NOT (bucket.same AND bucket.n > 1)"), F.lit(0)).unionByName(out(numbered, F.floor((F.col("number") + F.col("before")) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes"))))))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write one folder for each shard and part."""
    shard(docs, limit).repartition("shard", "part").write.partitionBy("shard", "part").parquet(path)


def oracle(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 15))::BIGINT AS h
  FROM documents),
levels AS (
  SELECT d, h >> (60 - d) AS prefix, sum(n_bytes) AS b, min(h) AS lo, max(h) AS hi
  FROM h, (SELECT unnest(range(0, 41))::INT AS d) GROUP BY ALL),
leaves AS (
  SELECT l.d, l.prefix FROM levels l LEFT JOIN levels p ON p.d = l.d - 1 AND p.prefix = l.prefix >> 1
  WHERE NOT (l.b > {limit} AND l.lo < l.hi) AND (l.d = 0 OR (p.b > {limit} AND p.lo < p.hi)))
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE lpad(bin(prefix), d, '0') END AS shard, d AS depth, n_bytes
FROM h JOIN leaves ON h.h >> (60 - leaves.d) = leaves.prefix"""
