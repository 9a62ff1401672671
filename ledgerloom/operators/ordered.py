"""Order-dependent work that stays distributed when one document holds most of the rows.

A plain window over a document puts the whole document in one task. Here the ordered rows of a document are
cut into chunks of bounded size: windows run inside a chunk, and only one summary row per chunk is ordered
over the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def running(df: DataFrame, by: list[str], ord_col: str, outs: dict[str, tuple[str, Column]],
            chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Add aggregates over the rows before the current one, per `by` in `ord_col` order.

    `ord_col` is an integer, unique within `by`. `outs` maps a new column to ("sum" | "max", expression);
    sums start at 0, maxima at null. Without `chunk_rows` the rows are not cut: for rows that are stored by document,
    which one task reads in order in any case, so that nothing is exchanged.
    """
    agg = {"sum": F.sum, "max": F.max}
    if chunk_rows is None:
        whole = Window.partitionBy(*by).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(agg[k](e).over(whole), F.lit(0)) if k == "sum" else agg[k](e).over(whole) for n, (k, e) in outs.items()}).select(*df.columns, *outs)
    d = df.withColumn("_chunk", F.floor(F.col(ord_col) / chunk_rows))
    before = Window.partitionBy(*by, "_chunk").orderBy(ord_col).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumns({f"_in_{n}": agg[k](e).over(before) for n, (k, e) in outs.items()})
    totals = d.groupBy(*by, "_chunk").agg(*[agg[k](e).alias(f"_tot_{n}") for n, (k, e) in outs.items()])
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_chunk", *[agg[k](f"_tot_{n}").over(earlier).alias(f"_off_{n}") for n, (k, _) in outs.items()])
    # Null-safe: rows with a null key are a group of their own.
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_chunk")]
    joined = local.alias("l").join(offsets.alias("r"), cond, "left").select("l.*", *[F.col(f"r._off_{n}") for n in outs])
    done = {}
    for n, (k, _) in outs.items():
        off, inn = F.col(f"_off_{n}"), F.col(f"_in_{n}")
        done[n] = F.coalesce(off, F.lit(0)) + F.coalesce(inn, F.lit(0)) if k == "sum" else F.greatest(off, inn)
    return joined.withColumns(done).select(*df.columns, *outs)


def number_rows(df: DataFrame, by: list[str], chunk: list[str], order: list[str], out: str) -> DataFrame:
    """1..n per `by` in (chunk, order) order; `chunk` columns cut a document into bounded pieces."""
    inner = Window.partitionBy(*by, *chunk).orderBy(*order)
    local = df.withColumn("_rn", F.row_number().over(inner))
    earlier = Window.partitionBy(*by).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*by, *chunk).agg(F.count(F.lit(1)).alias("_n"))
               .select(*by, *chunk, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")))
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, *chunk)]
    return (local.alias("l").join(offsets.alias("r"), cond, "left")
            .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_off") + F.col("_rn")).cast("int").alias(out)))


def in_documents(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows in order inside each document; documents stay where their hash puts them."""
    return df.repartition("document_id").sortWithinPartitions("document_id", *order)


def part_no(ord_col, size: int) -> Column:
    """Part of a document a row belongs to: a part never holds more than `size` rows."""
    return F.floor((F.col(ord_col) - 1) / size).cast("int")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank_no") -> DataFrame:
    """First k rows per `by`. Spark keeps at most k rows per key in each map task before the exchange."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_by(cols: list[str], ord_col) -> list[Column]:
    """Aggregates taking the values of the row with the smallest order."""
    return [F.min_by(c, ord_col).alias(c) for c in cols]


def last_by(cols: list[str], ord_col) -> list[Column]:
    return [F.max_by(c, ord_col).alias(c) for c in cols]
