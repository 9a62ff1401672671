import random

from pyspark.sql import functions as F

from ledgerloom.operators import ordered as O
from ledgerloom.operators.textjoin import GRAM, contains_join, contains_pairs, grams, rarest_grams


def test_running_equals_loop_with_one_hot_document(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"d{rnd.randrange(20)}", i, rnd.random() < 0.2) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc string, ord int, flag boolean").repartition(7)
    got = O.running(df, ["doc"], "ord", {"n": ("sum", F.col("flag").cast("int")), "last": ("max", F.when(F.col("flag"), F.col("ord")))}, chunk_rows=50)
    want, count, last = {}, {}, {}
    for doc, i, flag in sorted(rows, key=lambda r: r[1]):
        want[i] = (count.get(doc, 0), last.get(doc))
        count[doc] = count.get(doc, 0) + flag
        if flag:
            last[doc] = i
    assert {r["ord"]: (r["n"], r["last"]) for r in got.collect()} == want


def test_running_over_negative_order(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 300)], "doc string, ord int").withColumn("rev", -F.col("ord"))
    got = O.running(df, ["doc"], "rev", {"next": ("max", F.col("rev"))}, chunk_rows=16).collect()
    assert all(r["next"] == (None if r["ord"] == 299 else -(r["ord"] + 1)) for r in got)


def test_number_rows(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i // 10, i) for i in range(500)], "doc string, chunk int, k int").repartition(5)
    got = O.number_rows(df, ["doc"], ["chunk"], ["k"], "no").collect()
    for doc in "ab":
        mine = sorted((r["k"], r["no"]) for r in got if r["doc"] == doc)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_contains_join_equals_all_pairs(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("ab ") for _ in range(rnd.randrange(n)))
    holders, parts = sorted({text(25) for _ in range(150)}), sorted({text(12) for _ in range(150)} | {"", "a"})
    h = spark.createDataFrame([(x, i % 2) for i, x in enumerate(holders)], "h string, g int")
    p = spark.createDataFrame([(x, i % 2) for i, x in enumerate(parts)], "p string, g int")
    got = sorted((r["h"], r["p"]) for r in contains_join(h, "h", p, "p", ["g"]).collect())
    want = sorted((a, b) for i, a in enumerate(holders) for j, b in enumerate(parts) if b in a and i % 2 == j % 2)
    assert got == want


def test_contains_join_with_hot_grams_and_repeated_rows(spark):
    rnd = random.Random(6)
    words = ["total", "other", "assets", "net", "of", "deferred", "tax"]
    phrase = lambda n: " ".join(rnd.choices(words, k=n))
    holders = [phrase(rnd.randrange(1, 7)) for _ in range(200)] + ["total", "total", None, ""]
    parts = [phrase(rnd.randrange(1, 4)) for _ in range(80)] + ["tot", "x", "", None, "total", "total", "deferred taxes", "é漢字é"]
    h = spark.createDataFrame([(i, x) for i, x in enumerate(holders)], "hid int, h string")
    p = spark.createDataFrame([(i, x) for i, x in enumerate(parts)], "pid int, p string")
    want = sorted((i, j) for i, a in enumerate(holders) for j, b in enumerate(parts) if a is not None and b is not None and b in a)
    assert sorted((r.hid, r.pid) for r in contains_join(h, "h", p, "p").collect()) == want
    texts, wanted = h.filter("h IS NOT NULL").select(F.col("h").alias("_text")).distinct(), p.filter("p IS NOT NULL").select(F.col("p").alias("_part")).distinct()
    pairs = contains_pairs(texts, wanted, [], together=7)  # salted
    assert sorted((r["_text"], r["_part"]) for r in pairs.collect()) == sorted({(holders[i], parts[j]) for i, j in want})
    found = {r["_part"]: (r["_gram"], r["_holders"]) for r in rarest_grams(texts.withColumn("_gram", F.explode(grams("_text"))), wanted.filter(F.length("_part") >= GRAM), []).collect()}
    assert "deferred taxes" not in found and "é漢字é" not in found
    for part, (gram, n) in found.items():
        counts = {g: sum(g in t for t in {x for x in holders if x}) for g in {part[i : i + GRAM] for i in range(len(part) - GRAM + 1)}}
        assert n == min(counts.values()) == counts[gram]


def test_top_k_and_parts(spark):
    df = spark.createDataFrame([("hot", i) for i in range(1, 1001)] + [("b", 1)], "doc string, v int")
    assert sorted(r["v"] for r in O.top_k(df, ["doc"], [F.desc("v")], 3).collect()) == [1, 998, 999, 1000]
    sizes = df.groupBy("doc", O.part_no("v", 100).alias("part")).count().collect()
    assert max(r["count"] for r in sizes) == 100 and len(sizes) == 11
