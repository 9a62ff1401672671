"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards of bounded size by a hash of their id. In a shard equal vectors are one node; each node
gets a geometric random level, and on each level it links to the nearest nodes of that level which are nearer to it
than to a neighbour already chosen, fills up with the nearest passed over, and is linked back. Candidates come from
blocked exact products, which inserting one by one would approximate. Inner product is made a distance by one more coordinate that gives all vectors of a shard one norm.
A graph is one row of flat arrays. A query descends the levels of every shard's graph and searches the lowest with a
beam; each shard answers with its best, and a window over the answers ranks them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import groups, lists, row_arrays, sliced
from ledgerloom.session import materialise, tune

#: Vectors of a shard, on average; links of a node above and on the lowest level; candidates when linking; beam.
SHARD_ROWS, LINKS, LINKS_0, CANDIDATES, BEAM = 16384, 12, 32, 96, 320
#: Nodes of a beam expanded in one step; queries answered together.
EXPANDED, TOGETHER = 4, 250
#: Queries that one task answers from one shard.
PART_QUERIES = 2000
GRAPH = "ids array<long>, first array<int>, vectors array<double>, nodes array<int>, levels array<int>, neighbours array<int>"


class Graph(NamedTuple):
    ids: np.ndarray  # ids of all vectors, equal vectors together, each group ascending
    first: np.ndarray  # where a node's ids begin, and their number at the end
    vectors: np.ndarray  # one row per node, as given
    nodes: list[np.ndarray]  # the nodes of each level
    neighbours: list[np.ndarray]  # a row per node of the level: nodes, -1 for none


def _nearest(x: np.ndarray, nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node the n most similar others among `nodes`, best first, and the similarities."""
    n = min(n, len(nodes) - 1)
    own, at, near = x[nodes], np.empty((len(nodes), n), np.int64), np.empty((len(nodes), n), np.float32)
    for a in range(0, len(nodes), 512):
        s = own[a : a + 512] @ own.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
        value = np.take_along_axis(s, best, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        at[a : a + 512], near[a : a + 512] = nodes[np.take_along_axis(best, order, axis=1)], np.take_along_axis(value, order, axis=1)
    return at, near


def _link(x: np.ndarray, nodes: np.ndarray, links: int, most: int) -> np.ndarray:
    """Neighbours of the nodes of one level: diverse nearest ones, and those that chose the node."""
    out = np.full((len(nodes), most), -1, np.int32)
    if len(nodes) < 2:
        return out
    at, near = _nearest(x, nodes, CANDIDATES)
    chosen = np.full((len(nodes), links), -1, np.int64)
    taken = np.zeros(len(nodes), np.int64)
    for k in range(at.shape[1]):
        c = at[:, k]
        # Nearer to the node than to any neighbour chosen so far.
        rival = np.full(len(nodes), -np.inf, np.float32)
        for j in range(links):
            has = np.flatnonzero(taken > j)
            if len(has):
                rival[has] = np.maximum(rival[has], np.einsum("ij,ij->i", x[c[has]], x[chosen[has, j]]))
        keep = np.flatnonzero((taken < links) & (near[:, k] > rival))
        chosen[keep, taken[keep]] = c[keep]
        taken[keep] += 1
    # Free places go to the nearest that were passed over: without them, much of a dense cluster hangs on one node.
    for k in range(at.shape[1]):
        free = np.flatnonzero((taken < links) & ~(chosen == at[:, k, None]).any(axis=1))
        chosen[free, taken[free]] = at[free, k]
        taken[free] += 1
    row = np.empty(len(x), np.int64)
    row[nodes] = np.arange(len(nodes))
    source, place = np.nonzero(chosen >= 0)
    target = row[chosen[source, place]]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    own = np.concatenate([np.ones(len(source), bool), np.zeros(len(source), bool)])
    pair, at_first = np.unique(a * len(nodes) + b, return_index=True)
    a, b, own = pair // len(nodes), pair % len(nodes), own[at_first]
    # A node's own choice first, then those that chose it, nearest first; what does not fit is left out.
    order = np.lexsort((-np.einsum("ij,ij->i", x[nodes[a]], x[nodes[b]]), ~own, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < most
    out[a[keep], rank[keep]] = nodes[b[keep]]
    # Whoever nobody links to takes the last place of the first neighbour whose last is linked to from elsewhere.
    into = np.bincount(row[out[out >= 0]], minlength=len(nodes))
    for lost in np.flatnonzero(into == 0).tolist():
        for n in chosen[lost][chosen[lost] >= 0].tolist():
            own_row = out[row[n]]
            place = min(int((own_row >= 0).sum()), most - 1)
            if own_row[place] < 0 or into[row[own_row[place]]] > 1:
                if own_row[place] >= 0:
                    into[row[own_row[place]]] -= 1
                own_row[place] = nodes[lost]
                into[lost] += 1
                break
    return out


def build(ids: np.ndarray, vectors: np.ndarray) -> Graph:
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(axis=1)))
    first = np.append(np.flatnonzero(new), len(ids)).astype(np.int32)
    vectors = vectors[new]
    x = augmented(vectors)
    level = np.minimum(8, (-np.log(np.random.default_rng(len(x)).random(len(x))) / math.log(LINKS)).astype(int))
    nodes = [np.flatnonzero(level >= k).astype(np.int32) for k in range(int(level.max()) + 1)]
    return Graph(ids, first, vectors, nodes, [_link(x, n, LINKS, LINKS if k else LINKS_0) for k, n in enumerate(nodes)])


def augmented(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the coordinate that brings them to the largest norm: inner products order them as distances do."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1).astype(np.float32)


class Searcher:
    """Answers a block of queries from one graph, all of them one step at a time."""

    def __init__(self, graph: Graph) -> None:
        self.g, self.x = graph, augmented(graph.vectors)
        self.row = []
        for n in graph.nodes:
            row = np.full(len(self.x), -1, np.int32)
            row[n] = np.arange(len(n))
            self.row.append(row)

    def _layer(self, q: np.ndarray, entries: np.ndarray, beam: int, level: int) -> np.ndarray:
        """The beam's nodes for each query, -1 for none: until all of them have been expanded."""
        row, neighbours = self.row[level], self.g.neighbours[level]
        line = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x)), bool)
        nodes, score, done = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32), np.ones((len(q), beam), bool)

        def enter(rows: np.ndarray, near: np.ndarray) -> None:
            near = np.sort(near, axis=1)
            good = near >= 0
            good[:, 1:] &= near[:, 1:] != near[:, :-1]
            near = np.where(good, near, 0)
            good &= ~seen[rows[:, None], near]
            a, b = np.nonzero(good)
            seen[rows[a], near[a, b]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[a, b] = np.einsum("ij,ij->i", self.x[near[a, b]], q[rows[a]])
            all_s = np.concatenate([score[rows], s], axis=1)
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            score[rows] = np.take_along_axis(all_s, keep, axis=1)
            nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], near], axis=1), keep, axis=1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], ~good], axis=1), keep, axis=1)

        enter(line[:, 0], entries)
        while True:
            open_ = np.where(done, -np.inf, score)
            rows = np.flatnonzero(open_.max(axis=1) > -np.inf)
            if not len(rows):
                return np.where(score > -np.inf, nodes, -1)
            best = np.argpartition(-open_[rows], EXPANDED - 1, axis=1)[:, :EXPANDED]
            now = np.where(np.take_along_axis(open_[rows], best, axis=1) > -np.inf, np.take_along_axis(nodes[rows], best, axis=1), -1)
            done[rows[:, None], best] = True
            near = np.where((now >= 0)[:, :, None], neighbours[row[now]], -1)
            enter(rows, near.reshape(len(rows), -1))

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int, beam: int = BEAM) -> list[tuple[list[int], list[float]]]:
        """For each query the k best ids but its own and their inner products, best first, ties to smaller ids."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        found = np.full((len(q), 1), self.g.nodes[-1][0], np.int64)
        for level in range(len(self.g.nodes) - 1, -1, -1):
            found = self._layer(q, found, max(beam, k) if level == 0 else 8, level)
        out = []
        for query, mine, nodes in zip(queries, own.tolist(), found, strict=True):
            nodes = nodes[nodes >= 0]
            scored = zip(nodes.tolist(), (self.g.vectors[nodes] @ query).tolist(), strict=True)
            # Of equal vectors the k + 1 smallest ids hold every answer.
            pairs = sorted((-s, i) for n, s in scored for i in self.g.ids[self.g.first[n] : self.g.first[n + 1]][: k + 1].tolist() if i != mine)[:k]
            out.append(([i for _, i in pairs], [-s for s, _ in pairs]))
        return out


def _usable(vector: Column) -> Column:
    good = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def usable(embeddings: DataFrame) -> DataFrame:
    """(id, vector, dim) of the vectors that take part; rows that repeat an id and a vector are one."""
    rows = embeddings.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(_usable(F.col("vector"))).withColumn("dim", F.size("vector"))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One graph row for each shard: (dim, shard, and the flat arrays). Every vector is in one."""
    counts = vectors.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shard_rows)).cast("int").alias("shards"))
    counts = materialise(counts)
    rows = vectors.join(counts, "dim").select("dim", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), "id", "vector")

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(key: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = np.concatenate([b.column("id").to_numpy() for b in held])
            g = build(ids, np.stack([v for b in held for v in row_arrays(b.column("vector"), np.float64)]))
            sizes = np.array([len(n) for n in g.nodes], np.int32)
            return pa.record_batch({
                "dim": pa.array([int(key[0])], pa.int32()), "shard": pa.array([int(key[1])], pa.int32()), "ids": lists([g.ids], pa.int64()), "first": lists([g.first], pa.int32()), "vectors": lists([g.vectors.ravel()], pa.float64()),
                "nodes": lists([np.concatenate(g.nodes)], pa.int32()), "levels": lists([sizes], pa.int32()), "neighbours": lists([np.concatenate([n.ravel() for n in g.neighbours])], pa.int32()),
            })

        yield from groups(batches, ["dim", "shard"], finish)

    return materialise(rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard").mapInArrow(built, "dim int, shard int, " + GRAPH))


def _graph(batch: pa.RecordBatch, row: int) -> Graph:
    get = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
    dim, sizes = batch.column("dim")[row].as_py(), get("levels")
    nodes, flat = get("nodes"), get("neighbours")
    ends, rows, at = np.cumsum(sizes), [], 0
    for k, n in enumerate(sizes.tolist()):
        width = LINKS if k else LINKS_0
        rows.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    return Graph(get("ids"), get("first"), get("vectors").reshape(-1, dim), np.split(nodes, ends[:-1]), rows)


def search(graphs: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all shards for each query (id, vector, dim), its own id left out."""
    parts = max(1, math.ceil(queries.count() / PART_QUERIES))
    blank = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in GRAPH.split(", ")]
    names = [f.split()[0] for f in GRAPH.split(", ")]
    shards = graphs.select("dim", "shard")
    asked = queries.join(shards, "dim").select("dim", "shard", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "vector", *blank)
    copies = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"), *names)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for start in np.flatnonzero(np.concatenate(([True], (kinds[1:] == 0) | (kinds[:-1] == 0)))).tolist():
                stop = start + 1 if kinds[start] == 0 else start + int(np.argmin(np.append(kinds[start:], 0)))
                if kinds[start] == 0:
                    searcher = Searcher(_graph(batch, start))
                    continue
                for part in sliced(batch.slice(start, stop - start), TOGETHER):
                    own = part.column("id").to_numpy()
                    answers = searcher.nearest(np.stack(row_arrays(part.column("vector"), np.float64)), own, k, beam)
                    out = [(o, v, s) for o, (ids, scores) in zip(own.tolist(), answers, strict=True) for v, s in zip(ids, scores, strict=True)]
                    if out:
                        q, v, s = zip(*out, strict=True)
                        yield pa.record_batch({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    both = copies.unionByName(asked).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "kind")
    found = both.mapInArrow(answered, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """The k nearest other vectors of each one whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    `embeddings` has vec_id and embedding; more columns are ignored. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do null ids; vectors meet those of their own length only. Rows that repeat
    a vec_id are one candidate with its best score, and one query (of the smallest vector). Ties go to smaller ids. An
    empty table gives no rows.
    """
    tune(embeddings.sparkSession)
    vectors = usable(embeddings)
    queries = materialise(vectors.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")))
    return search(index(vectors, shard_rows), queries, k, beam)
