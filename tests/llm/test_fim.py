import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.fim import Forest, Plan, digests, fill_in_middle, restore


def plain(doc_id, text, plan):
    """n, form, prefix and middle code points, and output, by a regular expression over code points."""
    text, end = text or "", re.escape(plan.unit_end)
    units = re.findall(f"[^{end}]*{end}|[^{end}]+", text)
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = plan.prefix, plan.suffix, plan.middle
    if not text or any(x in text for x in (p, s, m)) or h[2] % 100 >= plan.rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < plan.spm:
        return len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def texts():
    rng = random.Random(5)
    out = [None, "", "\n", "\n\n\n", "no end", "one\n", "é\n\U0001f600b\nc", "<P>kept\n", "a<\nP>\n<", "x" * 3000, "\n" * 2000, "long line " * 400 + "\n" + "z\n" * 900]
    return out + ["".join(rng.choice(["a", "é", "漢", "\U0001f600", "\n", " ", "<", ">"]) for _ in range(rng.randrange(1500))) for _ in range(120)]


@pytest.mark.parametrize("plan", [Plan(), Plan(seed=1, rate=60, spm=0), Plan(unit_end=".", spm=100, prefix="[PRE]", suffix="[SUF]", middle="[MID]")])
def test_cuts_equal_a_plain_split(spark, plan):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a\nb\nc\n"), (3, "\n\n\n")]
    df = spark.createDataFrame([(i, t, "old", -1, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, form string, n int, k int").repartition(3)
    made = restore(fill_in_middle(df, plan), plan).collect()
    assert len(made) == len(rows) and {r.k: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made} == {k: plain(i, t, plan) for k, (i, t) in enumerate(rows)}
    assert all(r.restored == (r.text or "") for r in made)
    assert fill_in_middle(df.where("false"), plan).collect() == []


def test_trees_find_every_cut():
    rng = np.random.default_rng(2)
    pieces = [b"", b"\n", b"ab\n\nc", bytes(rng.choice([97, 10, 195, 169], 700).tolist()), b"", b"q" * 64, b"\n" * 65]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    forest = Forest(np.frombuffer(b"".join(pieces), np.uint8), ends, 10, block=8)
    assert forest.total(forest.units).tolist() == [p.count(b"\n") for p in pieces]
    for rank in range(0, 70):
        places, points = forest.cut(np.full(len(pieces), rank))
        for t, p in enumerate(pieces):
            line_ends = [i + 1 for i, c in enumerate(p) if c == 10]
            want = 0 if not rank else line_ends[rank - 1] if rank <= len(line_ends) else len(p)
            assert places[t] == want and points[t] == sum(c & 0xC0 != 0x80 for c in p[:want])


def test_malformed_text_keeps_its_bytes(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(X'61C30A62FF0A' as string)").alias("text"))
    assert {r.restored_sha256 for r in digests(df).collect()} == {hashlib.sha256(b"a\xc3\nb\xff\n").hexdigest()}


def test_ambiguous_marks_are_refused(spark):
    for bad in (Plan(prefix="<P>", suffix="<P>"), Plan(middle="M>"), Plan(prefix="<<P>"), Plan(unit_end="\r\n")):
        with pytest.raises(ValueError, match="mark|unit"):
            fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"), bad)
