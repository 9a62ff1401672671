import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import Target, block_order, mixed, plan
from ledgerloom.llm.sharding import shard, write_shards


def buckets(rows, limit):
    """Split by hash bits, one at a time, until a bucket fits or cannot split."""
    h = lambda i, t: format(int(hashlib.md5(f"{'' if i is None else i}|{'' if t is None else hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:15], 16), "060b")
    items = [(h(i, t), len((t or "").encode()), i) for i, t in rows]
    out = {}

    def split(prefix, part):
        if sum(n for _, n, _ in part) <= limit or len({x for x, *_ in part}) == 1:
            out.update({(i, x): prefix for x, _, i in part})
            return
        for bit in "01":
            if inside := [p for p in part if p[0][len(prefix)] == bit]:
                split(prefix + bit, inside)

    split("", items)
    return {i: p for (i, _), p in out.items()}


def test_shards_equal_one_bit_at_a_time(spark):
    rows = [(i, "é" * (i % 50)) for i in range(400)] + [(500, None), (501, ""), (502, "x" * 9000), (None, "none")]
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, shard string")
    for limit in (700, 5000, 10**9):
        got = shard(df, limit).collect()
        assert {r.doc_id: r.shard for r in got} == buckets(rows, limit) and len(got) == len(rows)
        sizes = Counter()
        for r in got:
            sizes[r.shard, r.part] += r.n_bytes
            assert r.depth == len(r.shard)
        assert all(s <= limit or s == 9000 for s in sizes.values())
    assert shard(df.where("false")).collect() == []


def test_equal_rows_are_dealt_to_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 100)] * 95 + [(2, "b" * 50), (3, None)], "doc_id long, text string").repartition(4)
    got = shard(df, 1000).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard, r.part] += r.n_bytes
    assert len(got) == 97 and max(sizes.values()) <= 1000 and sum(sizes.values()) == 9550
    write_shards(df, str(tmp_path / "s"), 1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 97


def brute_mix(rows, target):
    """Quotas by a plain bisection, passes by plain prefix sums."""
    n = lambda t: len((t or "").encode().split())
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += n(t)
    total = sum(tokens.values())
    share = {s: c / total for s, c in tokens.items() if c}

    def fits(a):
        w = {s: p**a for s, p in share.items()}
        z = sum(w.values())
        entropy = -sum(x / z * math.log(x / z) for x in w.values())
        passes = [w[s] / z / share[s] for s in share]
        budget = target.budget / total if target.budget is not None else 1 / min(passes)
        return (target.entropy is None or entropy <= target.entropy) and (target.repetitions is None or max(passes) * budget <= target.repetitions)

    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    else:
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
    w = {s: p**high for s, p in share.items()}
    z = sum(w.values())
    budget = target.budget if target.budget is not None else total * max(share[s] * z / w[s] for s in share)
    out = []
    for s in tokens:
        quota = math.floor(w[s] / z * budget + 0.5) if s in w else 0
        whole = quota // tokens[s] if tokens[s] else 1
        for epoch in range(whole + 1):
            key = lambda i, t: int(hashlib.md5(f"mix|{epoch}|{i if i is not None else hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
            sums = defaultdict(int)
            for i, t, x in rows:
                if x == s:
                    sums[key(i, t)] += n(t)
            before, starts = 0, {}
            for k in sorted(sums):
                starts[k] = (before, before + sums[k])
                before += sums[k]
            rest = quota - whole * tokens[s] if tokens[s] else 0
            out += [(i, s, epoch, starts[key(i, t)][0]) for i, t, x in rows if x == s and (epoch < whole or rest and starts[key(i, t)][1] <= rest)]
    return out


@pytest.mark.parametrize("target", [Target(), Target(repetitions=None), Target(entropy=1.0, repetitions=None, budget=900), Target(repetitions=1.3, budget=2500)])
def test_mixture_equals_plain_sums(spark, target):
    rows = [(i, "w " * (i % 37), "big" if i % 3 else f"s{i % 5}") for i in range(200)] + [(300, None, "empty"), (301, "a b", None), (None, "no id", "s1"), (7, "again and again", "big")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, epoch string").repartition(3)
    mixture, quotas = plan(df, target, block_tokens=100)
    got = block_order(mixture).collect()
    assert Counter((r.doc_id, r.source, r.epoch, r.start) for r in got) == Counter(brute_mix(rows, target))
    assert all(r.block == r.start // 100 for r in got)
    assert quotas.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    again = mixed(df, target)
    assert again.columns == df.columns and Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in got)


def test_mixture_of_nothing_and_of_empty_texts(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in mixed(df).collect()) == [1, 2]
    assert plan(df.where("false"))[0].collect() == [] and mixed(df.where("false")).collect() == []
