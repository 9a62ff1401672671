"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with share p of all tokens gets the weight p^a / sum(p^a). The exponent a between 0 (all sources alike) and 1
(as they are) is bisected: the smallest that keeps the entropy at or below a target and no source repeated more
often than a limit. Weights times the budget are quotas. A source is passed over whole as often as its quota holds
it and once more in part: each pass takes its documents in an order of its own, up to the quota, and cuts that order
into blocks of a fixed number of tokens; blocks of all sources are then ordered by a hash of their own.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import materialise, tune

#: Passes over a source at most, on average over its documents; tokens of a block.
REPETITIONS, BLOCK_TOKENS = 2.0, 1_000_000
#: Sections an interval is cut into by one look at the sources, and looks (16**10 = 2**40).
SECTIONS, LOOKS = 16, 10
#: Rows that share an ordering bucket of a pass, on average.
BUCKET_ROWS = 20_000
SEED = "mix"


class Target(NamedTuple):
    """What to aim for. `budget` in tokens; None: the least that passes over every source once."""

    entropy: float | None = None  # nats
    repetitions: float | None = REPETITIONS
    budget: int | None = None


def n_tokens(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _identity(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit(""))


def _order(identity: Column, epoch: Column) -> Column:
    """60 bits: a document's place in a pass. Rows of one doc_id share it."""
    key = F.concat_ws("|", F.lit(SEED), epoch.cast("string"), identity)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _too_flat(a: float, target: Target, total: float) -> list[Column]:
    """Aggregates that are true where the exponent a breaks a limit; p is a source's share."""
    weight = F.pow("p", F.lit(a))
    sums, logs = F.sum(weight), F.sum(weight * F.log(weight))
    broken = []
    if target.entropy is not None:
        broken.append(F.log(sums) - logs / sums > target.entropy)
    if target.repetitions is not None:
        # Passes over a source: weight * budget / tokens, which is p^(a - 1) up to a factor.
        most = F.max(F.pow("p", F.lit(a - 1)))
        budget = F.lit(float(target.budget)) * most / (sums * total) if target.budget is not None else most / F.min(F.pow("p", F.lit(a - 1)))
        broken.append(budget > target.repetitions)
    return broken


def exponent(shares: DataFrame, target: Target, total: float) -> float:
    """Smallest exponent that breaks no limit (1 where even that does)."""
    low, high = 0.0, 1.0
    for look in range(LOOKS):
        points = [low + (high - low) * k / SECTIONS for k in range(0 if look == 0 else 1, SECTIONS)]
        row = shares.agg(*(F.array(*_too_flat(a, target, total)).alias(f"a{k}") for k, a in enumerate(points))).first()
        fits = [a for k, a in enumerate(points) if not any(row[f"a{k}"])]
        if fits and fits[0] == 0.0:
            return 0.0
        width = (high - low) / SECTIONS
        high = fits[0] if fits else high
        low = high - width
    return high


def quotas(rows: DataFrame, target: Target = Target()) -> DataFrame:
    """(name, tokens, n, weight, quota, passes, rest) of each source of rows (name, n_tokens).

    A source without tokens has weight 0 and is passed over once, which costs nothing.
    """
    sources = materialise(rows.groupBy("name").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    total = float(sources.agg(F.sum("tokens")).first()[0] or 0)
    shares = sources.where("tokens > 0").select((F.col("tokens") / max(total, 1.0)).alias("p"))
    a = exponent(shares, target, total) if total else 1.0
    norm, least = shares.agg(F.sum(F.pow("p", F.lit(a))), F.min(F.pow("p", F.lit(a - 1)))).first() if total else (1.0, 1.0)
    budget = float(target.budget) if target.budget is not None else total * norm / least if total else 0.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / max(total, 1.0), F.lit(a)) / norm).otherwise(0.0)
    quota = F.floor(F.col("weight") * budget + 0.5).cast("long")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long")
    out = sources.withColumn("weight", weight).withColumn("quota", quota).withColumn("passes", whole).withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(0))
    return materialise(out)


def plan(docs: DataFrame, target: Target = Target(), block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The realised mixture (doc_id, source, epoch, place, start, n_tokens, block) and the quotas.

    `docs` has doc_id, text and source. `epoch` counts the passes over a source from 0, `place` is the 60-bit order
    within one, `start` the tokens before it. Rows of one doc_id come together; a null doc_id is ordered by its text,
    a null source is a source; null texts have no tokens. A last pass ends before the first document that its
    rest cannot hold. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    ids = docs.select("doc_id", "source", _name(F.col("source")).alias("name"), n_tokens(F.col("text")).alias("n_tokens"), _identity(F.col("doc_id"), F.col("text")).alias("identity"))
    ids = materialise(ids)
    q = quotas(ids, target)
    most = q.agg(F.max("n")).first()[0] or 1
    bits = max(1, math.ceil(math.log2(max(2, most / BUCKET_ROWS))))
    rows = ids.join(q.select("name", "passes", "rest"), "name").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("epoch")).where("epoch < passes OR rest > 0")
    rows = rows.withColumn("place", _order(F.col("identity"), F.col("epoch"))).withColumn("bucket", F.expr(f"shiftright(place, {60 - bits})")).drop("identity")
    # Tokens before a bucket come from the buckets' sums, those inside from the bucket alone.
    before = rows.groupBy("name", "epoch", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = before.select("name", "epoch", "bucket", F.coalesce(F.sum("t").over(W.partitionBy("name", "epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("name", "epoch", "bucket").orderBy("place")
    rows = rows.withColumn("upto", F.sum("n_tokens").over(inside.rangeBetween(W.unboundedPreceding, 0))).withColumn("start", F.coalesce(F.sum("n_tokens").over(inside.rangeBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(before, ["name", "epoch", "bucket"]).where("epoch < passes OR before + upto <= rest").withColumn("start", F.col("start") + F.col("before"))
    return rows.select("doc_id", "source", "epoch", "place", "start", "n_tokens", F.floor(F.col("start") / block_tokens).cast("long").alias("block")), q


def block_order(mixture: DataFrame) -> DataFrame:
    """The mixture with `block_key`: ascending, it interleaves the blocks of all sources and passes."""
    return mixture.withColumn("block_key", F.md5(F.concat_ws("|", F.lit(SEED), _name(F.col("source")), F.col("epoch").cast("string"), F.col("block").cast("string")).cast("binary")))


def mixed(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The rows of `docs`, each as often as the mixture takes it. Only ids and counts are exchanged, never texts."""
    mixture, q = plan(docs, target)
    last = mixture.select(_name(F.col("source")).alias("name"), "epoch", "place").join(q.select("name", "passes"), "name").where("epoch = passes").groupBy("name").agg(F.max("place").alias("cut"))
    taken = materialise(q.join(last, "name", "left").select(F.col("name").alias("__name"), F.col("passes").alias("__passes"), F.coalesce("cut", F.lit(-1)).alias("__cut")))
    place = _order(_identity(F.col("doc_id"), F.col("text")), F.col("__passes"))
    copies = F.col("__passes") + (place <= F.col("__cut")).cast("long")
    rows = docs.withColumn("__name", _name(F.col("source"))).join(taken, "__name").withColumn("__copies", copies).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
