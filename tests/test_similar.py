import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.similar import gram_signatures, similar_lines, words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def all_pairs(labels, chart, k):
    """The k best lines of each label by scoring every pair."""
    out = {}
    for by, label in labels:
        scored = []
        for line, statement, name, words in chart:
            if statement == by:
                a, b = {w for w in label.split(" ") if w}, set(words)
                overlap = len(a & b) / len(a | b) if a & b else 0.0
                edit = 1 - distance(label, name) / max(len(label), len(name), 1)
                scored.append((-round(overlap * 0.7 + edit * 0.3, 6), line))
        out[by, label] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize(("n", "k"), [(150, 3), (40, 7), (2, 3)])
def test_best_lines_equal_all_pairs(spark, n, k):
    rng = random.Random(n)
    lexicon = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 9))) for _ in range(40)]
    phrase = lambda most: " ".join(rng.choices(lexicon, k=rng.randint(1, most)))
    chart = [(f"L-{i:04d}", rng.choice("AB"), phrase(6)) for i in range(n)]
    chart = [(i, s, name, list(dict.fromkeys(w for w in f"{name} {phrase(3)}".split(" ")))) for i, s, name in chart]
    labels = {(rng.choice("AB"), phrase(5)) for _ in range(120)} | {("A", "zzzz"), ("A", ""), ("B", "q" * 90), ("C", "nothing here")}
    labels |= {("A", "".join(rng.choices("abcdeinorst ", k=rng.randint(1, 30))).strip()) for _ in range(60)}
    df = spark.createDataFrame(sorted(labels), "statement string, label string")
    lines = spark.createDataFrame(chart, "line_id string, statement string, name string, words array<string>")
    got = {}
    for r in similar_lines(df, lines, ["statement"], k).orderBy("cand_rank").collect():
        got.setdefault((r.statement, r.label), []).append((r.line_id, pytest.approx(r.score)))
    want = {key: v for key, v in all_pairs(labels, chart, k).items() if v}
    assert got == want


def test_missing_grams_are_twice_the_edits_at_most(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("abcd ", k=rng.randint(0, 12))), "".join(rng.choices("abcd ", k=rng.randint(0, 12)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = gram_signatures(F.col("a")), gram_signatures(F.col("b"))
    missing = sum((F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    assert df.filter(missing > 2 * F.levenshtein("a", "b")).count() == 0
    assert df.select(words_of(F.lit(" a  b a ")).alias("w")).first().w == ["a", "b"]
