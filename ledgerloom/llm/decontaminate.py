"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit check.

Words are lower-cased and stripped of ASCII punctuation. An item of m words is found in a text where a stretch of
the text is within e = floor(share * m) word edits (insert, delete, replace) of it.

An undisturbed run of (m - e) // (e + 1) words has to be left of an item within e edits, so that windows are cut
where a text and an item share such a run (of 3 words at most), on the diagonal of the run, as long as the item.
Each window and each item takes the walks of Chakraborty, Goldenberg and Koucky: at step j a random bit of (j, word)
says whether the walk moves on, which turns k edits into O(k^2) differing places with constant probability. Each of L
repetitions samples b places of one walk as a bucket key; windows that meet an item of their length in any bucket
are verified by the exact edit distance over free ends. L follows from the collision rate measured on all items
under random edits, and the recall asked for of the items of every length. Lengths that stay below it are verified
wherever a window shares a run with an item on their diagonal.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import sliced
from ledgerloom.session import materialise, tune

#: Share of an item's words that may be edited; recall asked of the buckets at that distance; places in a key.
EDITS, RECALL, PLACES = 0.2, 0.99, 3
#: Repetitions, at least and at most; each walk serves WALK_KEYS of them.
LEAST, MOST, WALK_KEYS = 128, 512, 8
#: Simulated edits for the items of like length, at least.
TRIALS = 500
#: Items indexed at once; further items take further passes. Longest run that marks a window.
ITEMS, RUN = 20_000, 3
ROWS, WINDOWS = 2000, 20_000
_PLAIN = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PLAIN = _PLAIN.translate(bytes.maketrans(b"\0!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 33))
#: Stands between the texts of a batch.
_BORDER = b"\0"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def edits_allowed(m: int, share: float = EDITS) -> int:
    return int(share * m + 1e-9)


def run_length(m: int, share: float = EDITS) -> int:
    e = edits_allowed(m, share)
    return max(1, min(RUN, (m - e) // (e + 1)))


def walks(windows: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """The first 1.5 m places of the CGK embedding of windows (rows of word ids, -1 after a window's length m).

    Most walks of 3 m steps are over after 2 m and all look alike from there.
    """
    rows, most = windows.shape
    flat = np.concatenate([windows, np.full((rows, 1), -1, windows.dtype)], axis=1).ravel()
    start = np.arange(rows) * (most + 1)
    at, end = start.copy(), start + lengths
    mixed = (windows_hash(flat) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    steps = (3 * most + 1) // 2
    out = np.empty((steps, rows), windows.dtype)
    for step in range(steps):
        out[step] = flat[at]
        x = mixed[at] + np.uint64((seed * 1_000_003 + step * 7919 + 1) * 0xBF58476D1CE4E5B9 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        # A fixed random bit of (walk, step, word) says whether the walk moves on.
        at += ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * (at < end)
    return out


def windows_hash(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint64) + np.uint64(11)


def keys(embedded: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """WALK_KEYS bucket keys per window: hashes of sampled places of one walk."""
    line, out = np.arange(len(lengths)), np.empty((len(lengths), WALK_KEYS), np.uint64)
    fraction = np.random.default_rng(1000 + walk).random((WALK_KEYS, PLACES))
    for k in range(WALK_KEYS):
        h = lengths.astype(np.uint64) * np.uint64(WALK_KEYS) + np.uint64(k + 1)
        for f in fraction[k]:
            place = (f * ((3 * lengths + 1) // 2)).astype(np.int64)
            h = (h ^ (embedded[place, line].astype(np.uint64) + np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        out[:, k] = h
    return out


def padded(rows: list[np.ndarray], fill: int = -1) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    out = np.full((len(rows), int(lengths.max(initial=0))), fill, np.int64)
    for row, r in zip(out, rows, strict=True):
        row[: len(r)] = r
    return out, lengths


def stratum(m: int) -> int:
    """Items of like length: four strata for each doubling."""
    return int(4 * math.log2(m))


def repetitions(items: list[np.ndarray], share: float, recall: float, most: int = MOST) -> tuple[int, set[int]]:
    """Repetitions that reach the recall in every stratum for items at their largest distance, by simulation on all items.

    Also the strata that stay below it with the most repetitions.
    """
    rng = np.random.default_rng(7)
    strata: dict[int, list[np.ndarray]] = defaultdict(list)
    for item in items:
        if edits_allowed(len(item), share):
            strata[stratum(len(item))].append(item)
    chosen = [group[k % len(group)] for _, group in sorted(strata.items()) for k in range(max(TRIALS, len(group)))]
    kind = np.array([stratum(len(i)) for i in chosen])
    pairs: list[np.ndarray] = []
    for item in chosen:
        m, edited = len(item), item.tolist()
        for _ in range(edits_allowed(m, share)):
            at, change = int(rng.integers(len(edited))), int(rng.integers(3))
            if change == 0:
                edited.insert(at, -5)
            elif change == 1 and len(edited) > 1:
                del edited[at]
            else:
                edited[at] = -5
        pairs += [item, np.array((edited + [-6] * m)[:m])]
    rows, lengths = padded(pairs)
    met = np.zeros(len(chosen), bool)
    weak: set[int] = set()
    for n in range(1, most // WALK_KEYS + 1):
        at = np.flatnonzero(~met)
        if len(at):
            both = np.stack([2 * at, 2 * at + 1], axis=1).ravel()
            k = keys(walks(rows[both], lengths[both], n), lengths[both], n)
            met[at] = (k[::2] == k[1::2]).any(axis=1)
        weak = {s for s in strata if met[kind == s].mean() < recall}
        if n * WALK_KEYS >= LEAST and not weak:
            return n * WALK_KEYS, weak
    return most, weak


class Index:
    """Items by run and by bucket; looked up by windows of a text."""

    def __init__(self, ids: list[int], texts: list[list[bytes]], share: float, recall: float, most: int = MOST) -> None:
        self.share = share
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.ids = ids
        self.items = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        number, weak = repetitions(self.items, share, recall, most)
        self.walks = math.ceil(number / WALK_KEYS)
        self.base = len(self.vocabulary) + 1
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            n = run_length(len(item), share)
            for j in range(len(item) - n + 1):
                runs[n].append((self.code(item[j : j + n]), j, len(item)))
        #: By run length: codes in order, with the run's place in an item and the item's length.
        self.runs = {n: tuple(np.array(c) for c in zip(*sorted(set(r)), strict=True)) for n, r in runs.items()}
        #: By walk: the items' bucket keys in order, and the items.
        self.buckets = []
        rows, lengths = padded(self.items)
        for w in range(1, self.walks + 1 if self.items else 1):
            k = keys(walks(rows, lengths, w), lengths, w)
            order = np.argsort(k, axis=None)
            self.buckets.append((k.ravel()[order], order // WALK_KEYS))

        #: Items the buckets find too seldom, by the runs on their diagonal: codes in order, and the items.
        direct = np.array([i for i, item in enumerate(self.items) if stratum(len(item)) in weak], np.int64)
        self.direct = (np.empty(0, np.uint64), direct)
        if len(direct):
            codes, row = self.diagonal(rows[direct], lengths[direct])
            order = np.argsort(codes)
            self.direct = (codes[order], direct[row[order]])

    def diagonal(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of windows or items with their length and place, and the rows they are of."""
        codes, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for m in np.unique(lengths).tolist():
            at, n = np.flatnonzero(lengths == m), run_length(m, self.share)
            h = np.full((len(at), m - n + 1), m, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(m - n + 1, dtype=np.uint64)
            for k in range(n):
                h = (h ^ windows_hash(rows[at, k : k + m - n + 1])) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            codes.append(h.ravel())
            owner.append(np.repeat(at, m - n + 1))
        return np.concatenate(codes), np.concatenate(owner)

    def code(self, run: np.ndarray) -> int:
        """Code of a run of words, in 64 bits as arrays count; runs that share one are told apart when windows are verified."""
        value = 0
        for w in run:
            value = (value * self.base + int(w) + 1) % 2**64
        return value - 2**64 if value >= 2**63 else value

    def windows(self, text: np.ndarray) -> np.ndarray:
        """(start, length) of the windows of a text that share a run with an item on their diagonal."""
        return np.unique(self.shared_runs(text)[:, :2], axis=0)

    def shared_runs(self, text: np.ndarray) -> np.ndarray:
        """(start, length, place of the run) of such windows, once for each run."""
        found = [np.empty((0, 3), np.int64)]
        for n, (codes, place, length) in self.runs.items():
            if len(text) < n:
                continue
            value = np.zeros(len(text) - n + 1, np.int64)
            known = np.ones(len(value), bool)
            for j in range(n):
                part = text[j : j + len(value)]
                value = value * self.base + part + 1
                known &= part >= 0
            at = np.flatnonzero(known)
            value = value[at]
            first = np.searchsorted(codes, value)
            hit = codes[np.minimum(first, len(codes) - 1)] == value
            at, first = at[hit], first[hit]
            count = np.searchsorted(codes, value[hit], side="right") - first
            k = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            run = np.repeat(at, count)
            found.append(np.stack([run - place[k], length[k], run], axis=1))
        return np.concatenate(found)

    def placed(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(document, start, length) of the windows of joined texts; a window is of the text its run lies in.

        It may begin before that text and end after it, where the item's first and last words are missing.
        """
        start, m, run = self.shared_runs(text).T
        return np.unique(np.stack([np.searchsorted(ends, run), start, m], axis=1), axis=0)

    def candidates(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(row, item) of the windows that meet an item of their length in a bucket."""
        found = [np.empty(0, np.int64)]
        for w, (codes, items) in enumerate(self.buckets, 1):
            value = keys(walks(rows, lengths, w), lengths, w).ravel()
            first = np.searchsorted(codes, value)
            at = np.flatnonzero(codes[np.minimum(first, len(codes) - 1)] == value)
            first, count = first[at], np.searchsorted(codes, value[at], side="right") - first[at]
            k = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.unique(np.repeat(at // WALK_KEYS, count) * len(self.items) + items[k]))
        codes, items = self.direct
        if len(codes):
            value, row = self.diagonal(rows, lengths)
            first = np.searchsorted(codes, value)
            at = np.flatnonzero(codes[np.minimum(first, len(codes) - 1)] == value)
            first, count = first[at], np.searchsorted(codes, value[at], side="right") - first[at]
            k = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.unique(np.repeat(row[at], count) * len(self.items) + items[k]))
        pairs = np.unique(np.concatenate(found))
        return np.stack([pairs // len(self.items), pairs % len(self.items)], axis=1)


def best_stretches(items: np.ndarray, lengths: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the least word edits between the item and any stretch of the region, and where the first such ends.

    Rows of word ids, filled up with different negative numbers.
    """
    rows, width = regions.shape
    row, step = np.zeros((rows, width + 1), np.int64), np.arange(width + 1)
    for j in range(items.shape[1]):
        on = np.flatnonzero(lengths > j)
        old = row[on]
        new = old + 1
        np.minimum(new[:, 1:], old[:, :-1] + (regions[on] != items[on, j, None]), out=new[:, 1:])
        row[on] = np.minimum.accumulate(new - step, axis=1) + step  # inserted words
    at = row.argmin(axis=1)
    return row[np.arange(rows), at], at


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, recall: float = RECALL, items_at_once: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, edits, item_words, last_word): one row for each document and item found in it.

    `docs` has doc_id and text, `benchmark` item_id and text; other columns are ignored. Null or wordless texts and
    items meet nothing; empty tables give no rows. `edits` is the least distance found, `last_word` the number of
    words up to the end of the first such stretch. Rows that repeat a doc_id are reported once, with the least
    edits. Items are indexed in blocks of bounded number; every block sees all documents.
    """
    spark = tune(docs.sparkSession)
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    blocks = max(1, math.ceil(items.count() / items_at_once))
    found = None
    for block in range(blocks):
        rows = sorted((r.item_id, bytes(r.text)) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect())
        rows = [(i, w) for i, t in rows if (w := words_of(t))]
        hits = _block_hits(docs, rows, share, recall)
        found = hits if found is None else found.unionByName(hits)
    best = F.min(F.struct("edits", "last_word")).alias("best")
    out = found.groupBy("doc_id", "item_id").agg(best, F.first("item_words").alias("item_words"))
    return out.select("doc_id", "item_id", F.col("best.edits").alias("edits"), "item_words", F.col("best.last_word").alias("last_word"))


def _cut(text: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Rows of `width` words from `start`; what lies outside low..high is filled."""
    place = start[:, None] + np.arange(width)
    inside = (place >= low[:, None]) & (place < high[:, None])
    return np.where(inside, text[np.where(inside, place, 0)], fill)


def _verified(index: Index, text: np.ndarray, begins: np.ndarray, ends: np.ndarray, found: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, edits, last word) of the windows that hold an item."""
    d, start, m = found.T
    windows = _cut(text, begins[d], np.minimum(ends[d], start + m), start, int(m.max(initial=0)), -2)
    windows[np.arange(windows.shape[1]) >= m[:, None]] = -1
    pairs = index.candidates(windows, m)
    out = []
    for a in range(0, len(pairs), 5000):
        row, item = pairs[a : a + 5000].T
        items, lengths = padded([index.items[i] for i in item.tolist()], -9)
        e = np.array([edits_allowed(n, index.share) for n in lengths.tolist()], np.int64)
        first = np.maximum(begins[d[row]], start[row] - 2 * e)
        regions = _cut(text, begins[d[row]], np.minimum(ends[d[row]], start[row] + lengths + 2 * e), first, int((lengths + 4 * e).max(initial=0)), -8)
        edits, last = best_stretches(items, lengths, regions)
        for k in np.flatnonzero(edits <= e).tolist():
            out.append((int(d[row[k]]), int(item[k]), int(edits[k]), int(first[k] - begins[d[row[k]]] + last[k])))
    return out


def _block_hits(docs: DataFrame, rows: list[tuple[int, list[bytes]]], share: float, recall: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index([i for i, _ in rows], [w for _, w in rows], share, recall).__dict__)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = object.__new__(Index)
        index.__dict__.update(shared.value)
        known = index.vocabulary | {_BORDER: -3}
        for batch in batches:
            for part in sliced(batch, ROWS):
                # All texts of the batch in one array of word ids, each with a border after it.
                words = b" \0 ".join([(t or b"").translate(_PLAIN) for t in part.column(1).to_pylist()] + [b""]).split()
                text = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                ends = np.flatnonzero(text == -3)
                begins = np.append(0, ends[:-1] + 1)
                found = index.placed(text, ends)
                hits = [hit for a in range(0, len(found), WINDOWS) for hit in _verified(index, text, begins, ends, found[a : a + WINDOWS])]
                if hits:
                    best: dict[tuple[int, int], tuple[int, int]] = {}
                    for d, item, edits, last in hits:
                        best[d, item] = min(best.get((d, item), (edits, last)), (edits, last))
                    ids = part.column(0).to_pylist()
                    yield pa.record_batch({
                        "doc_id": pa.array([ids[d] for d, _ in best], pa.int64()), "item_id": pa.array([index.ids[i] for _, i in best], pa.int64()), "edits": pa.array([e for e, _ in best.values()], pa.int32()),
                        "item_words": pa.array([len(index.items[i]) for _, i in best], pa.int32()), "last_word": pa.array([x for _, x in best.values()], pa.int64()),
                    })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(search, "doc_id long, item_id long, edits int, item_words int, last_word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """`docs` without the documents that hold a benchmark item. Documents with a null doc_id cannot be named and stay."""
    found = materialise(contamination(docs, benchmark, share).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
