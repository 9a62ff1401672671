import random

import numpy as np

from ledgerloom.llm.decontaminate import Index, best_stretches, contamination, decontaminate, edits_allowed, repetitions, run_length, stratum, words_of


def word(rng):
    return "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 5)))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        kind = rng.choice("idr")
        if kind == "i":
            out.insert(k, word(rng))
        elif kind == "d":
            del out[k]
        else:
            out[k] = word(rng)
    return out


def distance(item, text):
    """Least word edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for w in item:
        new = [row[0] + 1]
        for k, v in enumerate(text):
            new.append(min(row[k + 1] + 1, new[k] + 1, row[k] + (w != v)))
        row = new
    return min(row)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(i, [word(rng) for _ in range(m)]) for i, m in enumerate([4, 9, 14, 20, 33, 45, 59, 30])]
    docs = []
    for d in range(160):
        text = [word(rng) for _ in range(rng.randint(0, 120))]
        if d % 2:
            _, item = rng.choice(items)
            n = rng.randint(0, edits_allowed(len(item)) + 2)
            at = rng.randint(0, len(text))
            text[at:at] = edited(rng, item, n)
        docs.append((d, " ".join(w.upper() + "," if k % 7 == 0 else w for k, w in enumerate(text))))
    rows = [(d, t, "x", 1) for d, t in docs] + [(1000, None, None, None), (1001, "", "", 0), (None, " ".join(items[3][1]), "x", 1)]
    bench = [(i, " ".join(w) + ".", "y") for i, w in items] + [(50, None, "y"), (51, " .", "y")]
    df, b = spark.createDataFrame(rows, "doc_id long, text string, edits string, item_id int"), spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    want = {(d, i): e for d, t in docs for i, w in items if (e := distance(w, t.lower().replace(",", "").split())) <= edits_allowed(len(w))}
    want[None, 3] = 0
    for at_once in (20_000, 3):
        got = {(r.doc_id, r.item_id): r.edits for r in contamination(df, b, items_at_once=at_once).collect()}
        assert not set(got) - set(want)
        assert len(set(want) - set(got)) <= 0.02 * len(want)
        assert all(got[k] >= want[k] for k in got) and sum(got[k] != want[k] for k in got) <= 0.05 * len(got)
    kept = decontaminate(df, b)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got if d is not None}


def test_contamination_of_nothing(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, bench).collect() == []
    assert contamination(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), bench).collect() == []


def test_stretch_and_runs():
    items, text = np.array([[1, 2, 3, 4], [1, 2, -9, -9]]), np.array([[9, 9, 1, 2, 8, 4, 9], [3, 1, 5, 6, -8, -8, -8]])
    edits, last = best_stretches(items, np.array([4, 2]), text)
    assert edits.tolist() == [1, 1] and last.tolist() == [6, 2]
    assert [run_length(m) for m in (1, 4, 5, 10, 14, 40)] == [1, 3, 2, 2, 3, 3]
    assert words_of(b"A-b, C!\n") == [b"a", b"b", b"c"] and words_of(None) == []


def test_windows_lie_on_the_diagonal_of_a_shared_run():
    index = Index([1], [[b"a", b"b", b"c", b"d", b"e"]], 0.2, 0.9)
    text = np.array([index.vocabulary.get(w, -1) for w in (b"x", b"a", b"b", b"c", b"y", b"e")])
    assert [1, 5] in index.windows(text).tolist()


def test_item_without_its_ends_between_other_texts(spark):
    rng = random.Random(4)
    items = [(i, [word(rng) for _ in range(30)]) for i in range(12)]
    texts = []
    for i, item in items:
        texts += [(2 * i, [word(rng) for _ in range(40)]), (2 * i + 1, item[2:-2])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts] + [(99, "the last text")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in contamination(docs, bench).collect()}
    assert got == {(2 * i + 1, i, 4) for i, _ in items}


def test_repetitions_follow_the_hardest_lengths():
    rng = np.random.default_rng(5)
    short, long = [rng.integers(0, 5000, 5) for _ in range(300)], [rng.integers(0, 5000, 300) for _ in range(20)]
    alone, _ = repetitions(long, 0.2, 0.99)
    assert repetitions(short + long, 0.2, 0.99)[0] >= alone > repetitions(short, 0.2, 0.99)[0]
    assert repetitions(short + long, 0.2, 0.99, 8) == (8, {stratum(5), stratum(300)})


def test_items_without_enough_buckets_are_verified_directly():
    rng = random.Random(2)
    items = [[word(rng).encode() for _ in range(40)] for _ in range(30)]
    index = Index(list(range(30)), items, 0.2, 0.99, most=8)
    rows = np.array([item.tolist() for item in index.items])
    rows[:, [3, 8, 13, 18, 23, 28, 33, 38]] = -1
    assert {(k, k) for k in range(30)} <= {tuple(p) for p in index.candidates(rows, np.full(30, 40)).tolist()}
