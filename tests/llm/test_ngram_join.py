import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm.common import Shingles, components
from ledgerloom.llm.ngram_join import Block, keep_one, ngram_join, required, routes, streamed_links

SCHEMA = "doc_id long, text string, n string, whole string, component long"


def shingles(text, width=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("aeiou")
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            i += 1
            rows.append((i * 7 % 1009, " ".join(copy)))
    passage = " ".join(word() for _ in range(60))
    rows += [(2000 + k, " ".join(word() for _ in range(80)) + " " + passage) for k in range(10)]
    rows += [(3000, "A b"), (3001, "a\tB"), (3002, "b a"), (3003, " \n"), (3004, ""), (3005, "é É x y z"), (3006, "é é x y z")]
    return rows


def test_join_equals_all_pairs_with_parts_and_copies(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows] + [(4000, None, None, None, None)], SCHEMA).repartition(3)
    want = classes(rows) | {4000: (0, 4000)}
    for block_rows in (3, 1000):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df, block_rows=block_rows).collect()}
        assert got == want


def test_join_of_repeated_rows_and_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    other = " ".join(f"v{k}" for k in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (9, text), (9, other), (2, other), (None, text), (None, "alone with no one else")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join(df).collect())
    assert got == sorted([(5, 27, 2), (5, 27, 2), (9, 27, 2), (9, 27, 2), (2, 27, 2), (0, 27, 2), (0, 2, 0)])
    assert sorted((r.doc_id or 0) for r in keep_one(df).collect()) == [0, 0, 2]
    assert keep_one(df).columns == df.columns


def test_join_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ngram_join(df).collect() == [] and keep_one(df).collect() == []


def test_block_search_is_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(6, 50)).astype(np.uint64)) for _ in range(120)]
    sets += [np.unique(np.append(s[1:], np.uint64(999 + k))) for k, s in enumerate(sets[:40])]
    block, every = Block(sets), np.ones(len(sets), bool)
    for percent in (60, 85):
        for own in sets:
            a = set(own.tolist())
            want = {k for k, s in enumerate(sets) if 100 * len(a & set(s.tolist())) >= percent * len(a | set(s.tolist()))}
            assert set(block.linked(own, percent, every).tolist()) == want
    assert required(20, 85) == 17


def test_shingles_of_long_texts_are_whole():
    s = Shingles(3)
    s_small = [w.encode() for w in "one two three four".split()]
    assert len(s(b" ".join(s_small))) == 2
    text = b" ".join(b"w%d" % k for k in range(300_000))
    assert len(text) > 2 << 20 and len(s(text)) == 299_998
    assert (s(b"Ab\x0bc d") == s(b"aB c\rd")).all() and len(s(b"a b")) == 1 and not len(s(None)) and not len(s(b"\n"))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (500, 400)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_visitors_of_a_block_are_dealt_out(spark):
    members = [(k, 0, 0) for k in range(400)] + [(k, 500, 500) for k in range(500, 510)] + [(k, 0, 500) for k in range(200)]
    rows = routes(spark.createDataFrame(members, "rep long, cluster long, target long"), 10, 2).collect()
    sent = [(t.target, t.target_part, t.salt, t.resident, r.rep) for r in rows for t in r.to]
    tasks = {x[:3] for x in sent}
    homes = {k: {x[4] for x in sent if x[:3] == k and x[3]} for k in tasks}
    guests = {k: {x[4] for x in sent if x[:3] == k and not x[3]} for k in tasks}
    # Without salts, the last part of the first cluster has 390 guests, and the second cluster 200.
    assert max(map(len, guests.values())) <= 45 and max(map(len, homes.values())) <= 25
    assert all(homes[k] == homes[*k[:2], 0] for k in tasks)
    met = {(a, b) for k in tasks for b in homes[k] for a in homes[k] | guests[k]}
    assert all((a, b) in met or (b, a) in met for a in range(400) for b in range(a)) and all((a, b) in met for a in range(200) for b in range(500, 510))


def test_links_stream_past_the_residents():
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 2**40, 40)) for _ in range(5)]
    sets = [np.sort(np.append(rng.choice(base[k % 5], 39, False), 2**41 + k)) for k in range(90)]
    taken = 0

    def batches():
        nonlocal taken
        for a in range(0, 90, 9):
            taken += 1
            n = range(a, a + 9)
            yield pa.record_batch({"rep": pa.array(n, pa.int64()), "target": pa.array([0] * 9, pa.int64()), "part": pa.array([0] * 9, pa.int32()), "salt": pa.array([0] * 9, pa.int32()), "resident": pa.array([k < 20 for k in n]), "shingles": pa.array([sets[k].tolist() for k in n], pa.list_(pa.int64()))})

    label, seen = list(range(90)), []
    for out in streamed_links(batches(), 85):
        seen.append(taken)
        for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True):
            label = [label[b] if x == label[a] else x for x in label]
    assert all((label[a] == label[b]) == (a % 5 == b % 5) for a in range(90) for b in range(a))
    assert seen[0] <= 3 and len(set(seen)) > 5
