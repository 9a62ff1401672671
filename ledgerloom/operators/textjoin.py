"""Substring joins through the rarest character gram of each part instead of comparing every pair.

Every gram of a contained text is one of the text that holds it. A part is looked up by the one of its grams that the
fewest holders have; a gram that no holder has settles the part at once. Grams that many holders share even so are
dealt to salted keys. Parts shorter than a gram are grams of their own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a gram; holders of one gram that a join key keeps together, about.
GRAM, TOGETHER = 4, 10_000


def grams(text: str | Column, size: int = GRAM) -> Column:
    """Every distinct gram of a size inside a text; none of shorter texts."""
    c = F.col(text) if isinstance(text, str) else text
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1)))
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def rarest_grams(holder_grams: DataFrame, parts: DataFrame, on: list[str]) -> DataFrame:
    """(*on, _part, _gram, _holders): of each part the gram that the fewest holders have; parts no holder can have are gone."""
    spread = holder_grams.groupBy(*on, "_gram").agg(F.count(F.lit(1)).alias("_holders"))
    own = parts.withColumn("_gram", F.explode(grams("_part"))).join(spread, [*on, "_gram"], "left")
    held = F.coalesce("_holders", F.lit(0))
    return own.groupBy(*on, "_part").agg(F.min(F.struct(held.alias("n"), F.col("_gram").alias("g"))).alias("_least")).filter("_least.n > 0").select(
        *on, "_part", F.col("_least.g").alias("_gram"), F.col("_least.n").alias("_holders"))


def contains_pairs(holders: DataFrame, parts: DataFrame, on: list[str], together: int = TOGETHER) -> DataFrame:
    """(*on, _text, _part) for distinct holders (*on, _text) and parts (*on, _part), once for each pair."""
    held = holders.withColumn("_gram", F.explode(grams("_text")))
    probes = rarest_grams(held, parts.filter(F.length("_part") >= GRAM), on)
    probes = probes.withColumn("_salts", F.ceil(F.col("_holders") / together).cast("int"))
    wanted = probes.select(*on, "_gram", "_salts").distinct()
    salted = held.join(wanted, [*on, "_gram"]).withColumn("_salt", F.pmod(F.xxhash64("_text"), F.col("_salts")).cast("int")).drop("_salts")
    asked = probes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select(*on, "_part", "_gram", "_salt")
    pairs = salted.join(asked, [*on, "_gram", "_salt"]).filter(F.contains("_text", "_part")).select(*on, "_text", "_part")
    short = parts.filter(F.length("_part") < GRAM)
    # A short part is one of the holder's grams of its size; the empty one is in every text.
    tiny = holders.withColumn("_part", F.explode(F.concat(F.array(F.lit("")), *(grams("_text", n) for n in range(1, GRAM)))))
    return pairs.unionByName(tiny.join(short, [*on, "_part"]).select(*on, "_text", "_part"))


def contains_join(holders: DataFrame, holder: str, parts: DataFrame, part: str, on: list[str] | None = None) -> DataFrame:
    """Pairs where `holder` text contains `part` text, each pair once, equal on the columns `on`; null texts pair with nothing."""
    on = on or []
    texts = holders.filter(F.col(holder).isNotNull()).select(*on, F.col(holder).alias("_text")).distinct()
    wanted = parts.filter(F.col(part).isNotNull()).select(*on, F.col(part).alias("_part")).distinct()
    pairs = contains_pairs(texts, wanted, on)
    return (holders.withColumn("_text", F.col(holder)).join(pairs, [*on, "_text"]).drop("_text")
            .join(parts.withColumn("_part", F.col(part)), [*on, "_part"]).drop("_part"))
