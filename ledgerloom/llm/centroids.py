"""Centroid clustering over subvector dictionaries.

Vectors are turned into whole numbers and packed into chunks. In a chunk every block of neighbouring dimensions is
encoded losslessly: a dictionary of the distinct subvectors, and one code for each vector. Dictionaries are built
bottom up, those of two neighbouring blocks giving the pairs of codes of the wider one, as long as that saves work. A
round computes the exact squared distance of every distinct subvector of a chunk to every centroid once, and a vector's
distance is the sum of its codes' partial distances. Cluster sums come from counting codes for each cluster. Chunks
are written once and never exchanged; a round returns one partial sum for each chunk and cluster, added up by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lists, row_arrays
from ledgerloom.session import materialise, tune

#: The registered query: centroids, rounds, components, factor before the floor, seed of the first centroids.
K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of a chunk, and those whose codes are summed at once.
CHUNK, TOGETHER = 32_768, 2048
#: Whole components lie within this; 64 squared differences of such values still fit a long.
LIMIT = 1 << 27
#: The columns of a chunk: ids and which are null, block width, entries of each dictionary, dictionaries, codes by block.
CHUNKS = "ids array<long>, missing array<boolean>, width int, sizes array<int>, entries array<long>, codes array<int>"


class Encoded(NamedTuple):
    """A chunk: `entries[b]` are the distinct subvectors of block b, `codes[b]` the vectors' places in them."""

    width: int
    entries: list[np.ndarray]
    codes: list[np.ndarray]


def encode(values: np.ndarray, k: int) -> Encoded:
    """Dictionary-encode whole vectors, with the block width that takes the least work for `k` centroids."""
    n, dim = values.shape
    entries, codes = [], []
    for d in range(dim):
        distinct, code = np.unique(values[:, d], return_inverse=True)
        entries.append(distinct[:, None])
        codes.append(code)
    best = Encoded(1, entries, codes)
    work = lambda e: k * sum(x.size + n for x in e.entries)
    while best.width < dim and len(best.entries) % 2 == 0:
        entries, codes = [], []
        for b in range(0, len(best.entries), 2):
            right = len(best.entries[b + 1])
            pair, code = np.unique(best.codes[b] * right + best.codes[b + 1], return_inverse=True)
            entries.append(np.hstack((best.entries[b][pair // right], best.entries[b + 1][pair % right])))
            codes.append(code)
        wider = Encoded(best.width * 2, entries, codes)
        if work(wider) >= work(best):
            break
        best = wider
    return best


def assign(chunk: Encoded, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and squared distance of each vector of a chunk."""
    k, n = len(centroids), len(chunk.codes[0])
    tables = []
    for b, block in enumerate(chunk.entries):
        partial = np.zeros((len(block), k), np.int64)
        for j in range(chunk.width):
            partial += (block[:, j, None] - centroids[None, :, b * chunk.width + j]) ** 2
        tables.append(partial)
    cluster, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    taken = np.empty((min(n, TOGETHER), k), np.int64)
    for start in range(0, n, TOGETHER):
        stop = min(n, start + TOGETHER)
        total, part = np.zeros((stop - start, k), np.int64), taken[: stop - start]
        for table, code in zip(tables, chunk.codes, strict=True):
            total += np.take(table, code[start:stop], axis=0, out=part, mode="clip")
        cluster[start:stop] = total.argmin(axis=1)
        distance[start:stop] = total[np.arange(stop - start), cluster[start:stop]]
    return cluster, distance


def sums(chunk: Encoded, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster's vectors, from the number of times it has each code."""
    return np.hstack([np.bincount(cluster * len(block) + code, minlength=k * len(block)).reshape(k, len(block)) @ block for block, code in zip(chunk.entries, chunk.codes, strict=True)])


def chunks(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE, rows: int = CHUNK, k: int = K) -> DataFrame:
    """The vectors that take part, encoded in chunks of at most `rows`."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.bool_(), None, pa.int32(), pa.int64(), pa.int32()]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def chunk() -> pa.RecordBatch:
            ids, missing, values = (np.concatenate(x) for x in zip(*held, strict=True))
            e = encode(values, k)
            flat = [ids, missing, None, np.array([len(x) for x in e.entries]), np.concatenate([x.ravel() for x in e.entries]), np.concatenate(e.codes)]
            return pa.record_batch({n: pa.array([e.width], pa.int32()) if v is None else lists([v], kind) for n, v, kind in zip(names, flat, kinds, strict=True)})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - count)
                at += part.num_rows
                count += part.num_rows
                vectors = np.stack(row_arrays(part.column("vector"), np.float64))
                whole = np.clip(np.floor(vectors * scale), -LIMIT, LIMIT).astype(np.int64)
                held.append((part.column("id").fill_null(0).to_numpy(), part.column("id").is_null().to_numpy(zero_copy_only=False), whole))
                if count == rows:
                    yield chunk()
                    held, count = [], 0
        if held:
            yield chunk()

    return _usable(embeddings, dim).mapInArrow(packed, CHUNKS)


def _usable(embeddings: DataFrame, dim: int) -> DataFrame:
    """(id, vector) of the vectors with `dim` components, none of them null, infinite or NaN."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vector = F.col("embedding").cast("array<double>")
    return embeddings.where((F.size("embedding") == dim) & ~F.exists(vector, bad)).select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector"))


def first_centroids(embeddings: DataFrame, k: int, dim: int, scale: int, seed: int) -> list[list[int]]:
    """The `k` vectors with the smallest hex SHA-256 of `<seed>:<vec_id>`, as whole numbers; of equal ids the smallest vectors."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = _usable(embeddings, dim).select(order.alias("o"), "vector").orderBy(F.col("o").asc_nulls_last(), "vector").limit(k).collect()
    return [np.clip(np.floor(np.array(r.vector) * scale), -LIMIT, LIMIT).astype(np.int64).tolist() for r in rows]


def _encoded(batch: pa.RecordBatch, row: int, dim: int) -> Encoded:
    get = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
    width, sizes, entries, codes = batch.column("width")[row].as_py(), get("sizes").astype(np.int64), get("entries"), get("codes").astype(np.int64)
    blocks = dim // width
    return Encoded(width, [x.reshape(-1, width) for x in np.split(entries, np.cumsum(sizes * width)[:-1])], np.split(codes, blocks))


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, chunk: int = CHUNK) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector that takes part, and the final centroids.

    `embeddings` has vec_id and embedding; other columns are ignored. Vectors with exactly `dim` components, none null
    or non-finite, take part, with components floor(scale * x) as whole numbers (held within 2**27 of zero, so that a
    distance fits a long). The first centroids are the `k` vectors whose `<seed>:<vec_id>` hashes smallest, in that
    order; fewer vectors are fewer centroids. Each round assigns every vector to the nearest centroid (ties: the
    smaller number) and replaces every non-empty one by floor(sum / count) of its vectors; then all are assigned once
    more. Rows that repeat a vec_id are vectors of their own; a null vec_id is never a first centroid unless too few
    others are there. No vectors give no rows.
    """
    spark = tune(embeddings.sparkSession)
    centroids = first_centroids(embeddings, k, dim, scale, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    encoded = materialise(chunks(embeddings, dim, scale, chunk, len(centroids)))
    for _ in range(rounds):
        centroids = _moved(encoded, centroids, dim)
    at = np.array(centroids, np.int64)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, distance = assign(_encoded(batch, row, dim), at)
                ids, missing = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "missing"))
                yield pa.record_batch({"vec_id": pa.array(ids, pa.int64(), mask=missing.astype(bool)), "cluster": pa.array(number, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return materialise(encoded.mapInArrow(assigned, "vec_id long, cluster int, distance long")), centroids


def _moved(encoded: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The centroids after a round: exact floors of the mean of their vectors; empty ones stay."""
    at, k = np.array(centroids, np.int64), len(centroids)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                e = _encoded(batch, row, dim)
                number, _ = assign(e, at)
                n = np.bincount(number, minlength=k)
                total = sums(e, number, k)
                live = np.flatnonzero(n)
                yield pa.record_batch({"cluster": pa.array(live, pa.int32()), "n": pa.array(n[live], pa.int64()), "total": lists(list(total[live]), pa.int64())})

    parts = encoded.mapInArrow(summed, "cluster int, n long, total array<long>")
    added = parts.select("cluster", "n", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = at.tolist()
    for r in added.collect():  # one row for each component of a centroid
        out[r.cluster][r.d] = int(r.x) // r.n
    return out


def report(embeddings: DataFrame) -> DataFrame:
    """`cluster` with cluster_inertia, inertia and centroid_sha256, the digest of the final centroid's components."""
    spark = embeddings.sparkSession
    rows, centroids = cluster(embeddings)
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total, most = sum(inertia.values()), 2**63 - 1
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    table = spark.createDataFrame([(c, min(s, most), min(total, most), digest(c)) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rounds in DuckDB, on one row for each component."""
    near = lambda r: f"""
a{r} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c ON c.i = v.i GROUP BY ALL) GROUP BY r)"""
    step = lambda r: f"""{near(r)},
m{r} AS (SELECT a.c, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} a JOIN v ON v.r = a.r GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN s IS NULL THEN x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{r} LEFT JOIN m{r} USING (c, i))"""
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
v AS MATERIALIZED (SELECT r, unnest(range({dim})) AS i, unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)) AS x FROM e),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, embedding) - 1 AS c FROM e QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN v USING (r)),{",".join(step(r) for r in range(rounds))},{near(rounds)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN h USING (c)"""
