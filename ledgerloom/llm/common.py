"""Shared helpers: whole-text words, 64-bit shingle sets, the learning split and connected components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import materialise, tune

#: Odd multipliers of the shingle hash, one for each place in the shingle; the last two mix the sum.
PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
MIX = 0xFF51AFD7ED558CCD
#: Base of the words' polynomial hash (odd, so that it has an inverse modulo 2**64), and bytes hashed at once.
BASE, PIECE = 0xD1342543DE82EF95, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Shingles:
    """Shingle sets of whole texts; holds the tables of the hash."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.byte = np.random.default_rng(20240229).integers(1, 2**64, 256, np.uint64)
        self.word = np.ones(257, bool)
        self.word[[9, 10, 11, 12, 13, 32, 256]] = False
        self.power = self.inverse = np.empty(0, np.uint64)

    def words(self, text: bytes) -> np.ndarray:
        """64-bit hash of each word: a polynomial of its bytes, taken from running sums over the text."""
        found = []
        while text:
            piece, text = text, b""
            if len(piece) > PIECE and (cut := re.search(rb"[\x20\x09-\x0d]", piece[PIECE:])):
                piece, text = piece[: PIECE + cut.start()], piece[PIECE + cut.start() :]
            if len(piece) >= len(self.power):
                n = max(2 * len(self.power), len(piece) + 1, 1 << 14)
                self.power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)], dtype=np.uint64)
                self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(BASE, -1, 2**64), np.uint64)], dtype=np.uint64)
            buffer = np.frombuffer(piece, np.uint8)
            edge = np.zeros(len(buffer) + 2, bool)
            edge[1:-1] = self.word[buffer]
            edge = np.flatnonzero(edge[1:] != edge[:-1])
            first, last = edge[::2], edge[1::2]
            total = np.zeros(len(buffer) + 1, np.uint64)
            np.cumsum(self.byte[buffer] * self.power[: len(buffer)], out=total[1:])
            found.append(mixed((total[last] - total[first]) * self.inverse[first]))
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, np.uint64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's word shingles.

        Words are runs without ASCII white space, A-Z lower-cased. With fewer words than the width the whole
        sequence is the one shingle; without words the set is empty.
        """
        one = self.words(text.lower()) if text else np.empty(0, np.uint64)
        width = min(self.width, len(one))
        if not width:
            return one
        n = len(one) - width + 1
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total += one[k : k + n] * np.uint64(PLACES[k])
        total = mixed(total)
        total.sort()
        keep = np.ones(n, bool)
        np.not_equal(total[1:], total[:-1], out=keep[1:])
        return total[keep]


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(29))) * np.uint64(MIX)
    return value ^ (value >> np.uint64(32))


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one array for each row."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def row_arrays(column: pa.ListArray, kind: type = np.int64) -> list[np.ndarray]:
    """One array for each row of an Arrow list column; null counts as empty."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b].astype(kind, copy=False) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def sliced(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], finish: Callable[[tuple, list[pa.RecordBatch]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Hand each run of equal keys of a sorted partition to `finish`; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new).tolist()
        for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != current:
                if (out := finish(current, held)) is not None:
                    yield out
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held and (out := finish(current, held)) is not None:
        yield out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges `a`, `b` (long); component is the smallest id it reaches.

    Large-star and small-star in turn: each round hangs every node below the smallest node seen near it, so a
    component of any shape becomes a star in about log rounds. Each round is written to the shared folder, so
    that a lost executor costs one round; hot nodes are aggregated before they are exchanged and the joins
    leave skew to adaptive execution. No edges give no rows; nulls and loops are ignored.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
