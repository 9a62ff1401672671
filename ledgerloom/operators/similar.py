"""The most similar lines of a chart for each label: shared words first, then edit distance in length bands.

score = 0.7 * (shared words / all words) + 0.3 * (1 - edit distance / longer length), rounded to six places. Lines that
share a word come from an equi-join on words. Any other line scores 0.3 at most, by its edit distance alone, so that a
label's k-th best score so far says how far a line may be: its length falls into a few bands, the grams of one text
that the other lacks are at most twice the edits, and the distance is computed up to that bound only. Near bands go
first and raise the bound for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import top_k

WORDS, EDITS = 0.7, 0.3
#: Code points of a length band; length ratio of the bands that go first; buckets of grams in each of two signatures.
BAND, NEAR, BITS = 4, 0.75, 64
#: Scores are rounded to six places, bounds therefore loosened by this.
SLACK = 1e-6


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: F.length(w) > 0))


def gram_signatures(text: Column) -> list[Column]:
    """Which of 2 * 64 hash buckets the text's character bigrams (ends marked) fall into."""
    marked = F.concat(F.lit("\x01"), text, F.lit("\x01"))
    places = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.pmod(F.xxhash64(F.substring(marked, i, F.lit(2))), F.lit(2 * BITS)).cast("int"))
    bits = lambda low: F.aggregate(F.filter(places, lambda p: (p >= low) & (p < low + BITS)), F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p - low)))
    return [bits(0).alias("_g0"), bits(BITS).alias("_g1")]


def _edit_score(distance: Column, a: str, b: str) -> Column:
    return 1 - distance / F.greatest(F.length(a), F.length(b), F.lit(1))


def similar_lines(labels: DataFrame, chart: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """(*by, label, line_id, score, cand_rank): the k best lines of each label among those equal in `by`.

    `labels` has `by` and label, each pair once; `chart` has `by`, line_id, name and words (an array). Ties go to the
    smaller line_id; a label gets fewer rows only where its part of the chart has fewer lines.
    """
    keys = [*by, "label"]
    size = F.length("label")
    wanted = labels.select(*keys, words_of(F.col("label")).alias("_lw"), size.alias("_la"), *gram_signatures(F.col("label")))
    lines = chart.select(*by, "line_id", "name", F.col("words").alias("_cw"), F.length("name").alias("_lb"), *[c.alias(f"_c{i}") for i, c in enumerate(gram_signatures(F.col("name")))])
    wanted, lines = materialise(wanted), materialise(lines.withColumn("_band", F.floor(F.col("_lb") / BAND).cast("int")))

    def best(scored: DataFrame) -> DataFrame:
        return materialise(top_k(scored.select(*keys, "line_id", "score"), keys, [F.desc("score"), F.col("line_id")], k, "cand_rank"))

    shared = (wanted.select(*keys, "_lw", F.explode("_lw").alias("_word")).join(lines.select(*by, "line_id", "name", "_cw", F.explode("_cw").alias("_word")), [*by, "_word"])
              .groupBy(*keys, "line_id", "name", F.size("_lw").alias("_nl"), F.size("_cw").alias("_nc")).agg(F.count(F.lit(1)).alias("_both")))
    overlap = F.col("_both") / (F.col("_nl") + F.col("_nc") - F.col("_both"))
    found = best(shared.withColumn("score", F.round(overlap * WORDS + _edit_score(F.levenshtein("label", "name"), "label", "name") * EDITS, 6)))
    last = lines.agg(F.coalesce(F.max("_band"), F.lit(0))).first()[0]
    for near in (True, False):
        kth = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_t")).filter(F.col("_n") >= k)
        # The least edit similarity that can still reach the k-th score: 0 while there are fewer lines.
        least = F.greatest(F.lit(0.0), F.coalesce((F.col("_t") - SLACK) / EDITS, F.lit(0.0)))
        waiting = wanted.join(kth.select(*keys, "_t"), keys, "left").withColumn("_s", least).filter("_s <= 1")

        def bands(share: Column) -> Column:
            low = F.floor(share * F.col("_la") / BAND).cast("int")
            high = F.when(share > 0, F.least(F.lit(last), F.ceil(F.col("_la") / share / BAND).cast("int"))).otherwise(last)
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        first = bands(F.greatest(F.lit(NEAR), F.col("_s")))
        looked = first if near else F.array_except(bands(F.col("_s")), first)
        pairs = waiting.withColumn("_band", F.explode(looked)).join(lines, [*by, "_band"])
        edits = F.floor((1 - F.col("_s")) * F.greatest("_la", "_lb") + SLACK).cast("int")
        missing = lambda a, b: F.bit_count(F.col(f"_{a}0").bitwiseAND(F.bitwise_not(f"_{b}0"))) + F.bit_count(F.col(f"_{a}1").bitwiseAND(F.bitwise_not(f"_{b}1")))
        pairs = pairs.filter((F.greatest(missing("g", "c"), missing("c", "g")) <= 2 * edits) & ~F.arrays_overlap("_lw", "_cw"))
        pairs = pairs.withColumn("_d", F.call_function("levenshtein", F.col("label"), F.col("name"), edits)).filter("_d >= 0")
        scored = pairs.withColumn("score", F.round(_edit_score(F.col("_d"), "label", "name") * EDITS, 6))
        found = best(found.select(*keys, "line_id", "score").unionByName(scored.select(*keys, "line_id", "score")))
    return found
