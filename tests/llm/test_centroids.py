import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm.centroids import assign, chunks, cluster, encode, report, sums


def brute(rows, k, rounds, dim, scale, seed):
    """Lloyd rounds in whole numbers, one vector at a time."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept))
    at = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(at)]
    return sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in kept), at


def test_encoding_is_lossless_and_distances_are_exact():
    rng = np.random.default_rng(1)
    for n, dim, spread in ((1, 8, 3), (300, 8, 2), (300, 6, 50), (50, 1, 4), (200, 8, 1)):
        values, at = rng.integers(-spread, spread + 1, (n, dim)), rng.integers(-spread, spread + 1, (5, dim))
        e = encode(values, 5)
        assert (np.hstack([x[c] for x, c in zip(e.entries, e.codes, strict=True)]) == values).all()
        all_pairs = ((values[:, None] - at[None]) ** 2).sum(axis=2)
        number, distance = assign(e, at)
        assert (number == all_pairs.argmin(axis=1)).all() and (distance == all_pairs.min(axis=1)).all()
        assert (sums(e, number, 5) == [values[number == c].sum(axis=0) for c in range(5)]).all()
    assert encode(np.ones((100, 8), int), 5).width == 8  # one distinct vector: one entry for all dimensions


@pytest.mark.parametrize("chunk", [7, 1000])
def test_clusters_equal_plain_rounds(spark, chunk):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 3, 0.2) for _ in range(4)]) for i in range(120)]
    rows += [(500 + i, [1.0, 1.0, -1.0, 0.5]) for i in range(60)]  # a third of all are copies
    rows += [(7, [0.1, 0.2, 0.3, 0.4]), (None, [0.0, -0.0, 0.5, 2.0]), (900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<double>, cluster string, id int").repartition(3)
    got, at = cluster(df, k=9, rounds=3, dim=4, scale=16, seed=5, chunk=chunk)
    want, centroids = brute(rows, 9, 3, 4, 16, 5)
    assert at == centroids
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.collect()) == want
    assert all(len(r.ids) <= chunk for r in chunks(df, 4, 16, chunk, 9).collect())


def test_few_huge_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got, at = cluster(df, k=5, rounds=2, dim=2)
    assert len(at) == 3 and sorted((r.vec_id, r.distance) for r in got.collect()) == [(1, 0), (2, 0), (2, 0)]
    assert cluster(df.where("vec_id > 9"), dim=2)[0].collect() == []
    assert report(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and report(df).collect() == []
