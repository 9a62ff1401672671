"""N-gram Jaccard join: T-occurrence search with short lists merged and long lists probed (DivideSkip).

Two texts link when the Jaccard similarity of their word-shingle sets reaches the threshold. A text x can only
link with texts that share at least T = ceil(threshold * |x|) of its shingles. Its |x| - T + 1 rarest
shingles therefore hold one shared shingle at least, and only these short lists are exchanged:

1. count the repeated shingles; their counts, in a table of fixed size indexed by hash bits, fix one order of
   shingles for everybody (cells may be shared and rare shingles missing: results do not depend on the order);
2. per document: set size, identity of the set and the short lists it is in. Equal sets collapse to one
   representative, so that groups of copies of any size cost one row per task;
3. with |x| - T + l short lists each, linked texts share l of them at least. A representative joins the cluster of
   the smallest one it shares l lists with, and visits the later clusters it shares l lists with;
4. in each block of a cluster, whose visitors are dealt to several tasks and pass one by one, DivideSkip: merge the short lists, keep what occurs T - L times, look the survivors
   up in the L long lists by binary search, retain exact links. A spanning forest of the links leaves the block, never
   its pairs;
5. connected components of the links, carried over to the copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Shingles, components, lists, row_arrays, sliced
from ledgerloom.session import materialise, tune

#: Leading hash bits that index the table of counts (one byte a cell), and the cells collected for it at most.
CELL_BITS, CELLS = 22, 400_000
#: Short lists that a candidate has to share.
SHARED = 6
#: Shingles sorted at once while counting.
CHUNK = 4_000_000
#: Representatives in one block of a cluster, about; visitors of a block in one task, about, for each of them.
BLOCK_ROWS, VISITORS = 1000, 4
#: Shingles handed on in one Arrow batch, about.
SENT = 2_000_000
#: Arrow rows worked on at once.
ROWS = 2000


def required(n: int, percent: int) -> int:
    """Shingles that a partner of a set of n shingles has to share."""
    return -(-percent * n // 100)


def shingle_counts(texts: DataFrame, width: int, cells: int = CELLS) -> np.ndarray:
    """Counts (up to 255) of the shingles that repeat, in cells indexed by the leading hash bits."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size = Shingles(width), [], 0

        def repeated() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts > 1
            return pa.record_batch({"shingle": pa.array(values[keep].view(np.int64)), "n": pa.array(counts[keep])})

        for batch in batches:
            for part in sliced(batch, ROWS):
                for text in part.column(0).to_pylist():
                    held.append(shingles(text))
                    size += len(held[-1])
                    if size > CHUNK:
                        yield repeated()
                        held, size = [], 0
        if held:
            yield repeated()

    sums = texts.select(F.col("text").cast("binary")).mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    sums = materialise(sums.groupBy(F.shiftrightunsigned("shingle", 64 - CELL_BITS).cast("int").alias("cell")).agg(F.max("n").alias("n")))
    # The least count for which the cells stay within their number, by powers of two: at most 64 sums.
    by_power = {r.p: r.c for r in sums.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("c")).collect()}
    least, total = 64, 0
    for p in sorted(by_power, reverse=True):
        total += by_power[p]
        if total > cells:
            break
        least = p
    top = sums.where(F.col("n") >= float(2**least)).toArrow()
    counts = np.zeros(2**CELL_BITS, np.uint8)
    counts[top.column("cell").to_numpy()] = np.minimum(top.column("n").to_numpy(), 255)
    return counts


def smallest(percent: int) -> int:
    """Least size of a set that can link with a different one (with itself plus one more shingle)."""
    return -(-percent // (100 - percent)) if percent < 100 else 2**31


def rarest(values: np.ndarray, counts: np.ndarray, percent: int, shared: int) -> np.ndarray:
    """The |x| - T + l shingles of a set that come first in the common order (count, then hash)."""
    n = len(values)
    if n < smallest(percent):
        return values[:0]
    return values[np.lexsort((values, counts[values >> np.uint64(64 - CELL_BITS)]))[: n - required(n, percent) + shared]]


class Block:
    """Inverted lists of the sets of one block; answers which of them link with a set."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.keys, starts = np.unique(flat[order], return_index=True)
        self.owners, self.starts = owner[order], np.append(starts, len(flat))

    def linked(self, query: np.ndarray, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Members whose overlap with the query is large enough, of those that `wanted` marks."""
        at = np.searchsorted(self.keys, query)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == query)]
        need = required(len(query), percent)
        if len(at) < need:
            return at[:0]
        found = sorted((self.owners[self.starts[k] : self.starts[k + 1]] for k in at), key=len)
        long_lists = min(need - 1, int(need / (0.01 * math.log2(len(found[-1]) + 1) + 1)))
        cut = len(found) - long_lists
        # Timsort takes the sorted short lists as runs and merges them.
        merged = np.sort(np.concatenate(found[:cut]), kind="stable")
        first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        members, count = merged[first], np.diff(np.append(first, len(merged)))
        sizes = self.sizes[members]
        keep = (count >= need - long_lists) & wanted[members] & (sizes >= need) & (percent * sizes <= 100 * len(query))
        members, count = members[keep], count[keep]
        for k, values in enumerate(found[cut:]):
            place = np.searchsorted(values, members)
            count = count + (values[np.minimum(place, len(values) - 1)] == members)
            if k % 8 == 7:
                keep = count + (long_lists - k - 1) >= need
                members, count = members[keep], count[keep]
            if not len(members):
                break
        return members[100 * count >= percent * (len(query) + self.sizes[members] - count)]


class Links:
    """Links of the rows that pass a block with its residents: a spanning forest of all links with a resident.

    Only the residents are held, with a label each: residents of one label are connected already.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int) -> None:
        self.ids, self.sets, self.percent = ids, sets, percent
        self.block, self.label = Block(sets), np.arange(len(ids))

    def among_residents(self) -> list[tuple[int, int]]:
        edges = []
        for i, own in enumerate(self.sets):
            # What is connected already need not be looked up.
            for j in self.block.linked(own, self.percent, self.label != self.label[i]):
                if self.label[i] != self.label[j]:
                    self.label[self.label == self.label[i]] = self.label[j]
                    edges.append((self.ids[i], self.ids[j]))
        return edges

    def of_visitor(self, rep: int, own: np.ndarray) -> list[tuple[int, int]]:
        edges, every = [], np.ones(len(self.ids), bool)
        found = self.block.linked(own, self.percent, every)
        for j in found:
            if not edges or self.label[j] != self.label[found[0]]:
                self.label[self.label == self.label[j]] = self.label[found[0]]
                edges.append((rep, self.ids[j]))
        return edges


def streamed_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the blocks of a partition sorted by target, part, salt and residents first.

    One block's residents and one batch of visitors are held at a time. Every salt of a block has all its
    residents; their own links are left to salt 0.
    """
    current: tuple | None = None
    held: list[tuple[int, np.ndarray]] = []
    links: Links | None = None

    def opened() -> list[tuple[int, int]]:
        nonlocal links
        ids, sets = zip(*held, strict=True)
        links = Links(list(ids), list(sets), percent)
        held.clear()
        return links.among_residents() if not current[2] and len(ids) > 1 else []

    def edges_of(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    for batch in batches:
        for part in sliced(batch, ROWS):
            found: list[tuple[int, int]] = []
            keys = zip(*(part.column(k).to_pylist() for k in ("target", "part", "salt")), strict=True)
            rows = zip(keys, part.column("rep").to_pylist(), part.column("resident").to_pylist(), row_arrays(part.column("shingles")), strict=True)
            for key, rep, resident, own in rows:
                if key != current:
                    if len(held) > 1:
                        found += opened()
                    held.clear()
                    current, links = key, None
                # A copy: a view would hold its whole batch.
                own = own.view(np.uint64)
                if resident:
                    held.append((rep, own.copy()))
                    continue
                if held:
                    found += opened()
                if links is not None:
                    found += links.of_visitor(rep, own)
            yield from edges_of(found)
    if len(held) > 1:
        yield from edges_of(opened())


def routes(visits: DataFrame, block_rows: int, visitors: int = VISITORS) -> DataFrame:
    """(rep, to): the blocks each representative goes to, as an array of target, target_part, salt and resident.

    A cluster of many parts: its members are dealt to the parts, and each visits the parts after its own. The
    visitors of a part are dealt to salts, and its residents go to each of them.
    """
    home = F.sum((F.col("target") == F.col("cluster")).cast("int"))
    sizes = visits.groupBy("target").agg(F.count("*").alias("c"), home.alias("home")).where("c > 1")
    sizes = materialise(sizes.select("target", (F.col("c") - F.col("home")).alias("outside"), "home", F.greatest(F.ceil(F.col("home") / block_rows), F.lit(1)).cast("int").alias("parts")))
    routed = visits.join(sizes, "target").join(sizes.select(F.col("target").alias("cluster"), F.col("parts").alias("own")), "cluster", "left")
    part = F.pmod(F.xxhash64("rep"), F.coalesce("own", F.lit(1))).cast("int").alias("part")
    routed = routed.select("rep", "cluster", "target", "outside", "home", "parts", part, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("target_part"))
    routed = routed.where("target > cluster OR target_part >= part")
    salts = F.greatest(F.lit(1), F.ceil((F.col("outside") + F.col("home") * F.col("target_part") / F.col("parts")) / (visitors * block_rows))).cast("int")
    resident = (F.col("target") == F.col("cluster")) & (F.col("part") == F.col("target_part"))
    routed = routed.select("rep", "target", "target_part", salts.alias("salts"), resident.alias("resident"))
    every, one = F.sequence(F.lit(0), F.col("salts") - 1), F.array(F.pmod(F.xxhash64("rep", "target", "target_part"), F.col("salts")).cast("int"))
    routed = routed.select("rep", "target", "target_part", "resident", F.explode(F.when(F.col("resident"), every).otherwise(one)).alias("salt"))
    return routed.groupBy("rep").agg(F.collect_set(F.struct("target", "target_part", "salt", "resident")).alias("to"))


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85, block_rows: int = BLOCK_ROWS, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of `docs` (doc_id long, text string; more columns are ignored).

    Null or wordless text: no shingles, linked with nothing, component_id is the document itself. Rows that share
    a doc_id are one document: their links join. A row without doc_id names no document and links nothing; its
    component_id is that of a document with an equal shingle set, else null. An empty table gives no rows.
    """
    spark = tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    counts = spark.sparkContext.broadcast(shingle_counts(texts, width, cells))
    shared_lists = min(SHARED, required(smallest(percent), percent))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            for part in sliced(batch, ROWS):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                whole = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                short = [rarest(s, counts.value, percent, shared_lists).view(np.int64) for s in sets]
                yield pa.record_batch({
                    "doc_id": part.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "whole": pa.array(whole, pa.binary()),
                    "short": lists(short, pa.int64()),
                })

    rows = materialise(texts.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(described, "doc_id long, n long, whole binary, short array<long>"))
    reps = materialise(rows.where("n > 0").groupBy("whole").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("short").alias("short")))

    posted = reps.where("rep IS NOT NULL").select("rep", "n", F.explode("short").alias("shingle"))
    several = posted.groupBy("shingle").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("shingle", F.col("lo").alias("lead"))
    shared = materialise(posted.join(several, "shingle"))
    led = shared.groupBy("rep", "lead").agg(F.count("*").alias("c")).groupBy("rep").agg(F.min(F.when(F.col("c") >= shared_lists, F.col("lead"))).alias("lead"))
    clustered = materialise(shared.select("rep", "n", "shingle").join(led.select("rep", F.coalesce("lead", "rep").alias("cluster")), "rep"))
    lists_of = clustered.groupBy("shingle", F.col("cluster").alias("target")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (100 * F.col("least") * percent <= 10_000 * F.col("n")) & (100 * F.col("most") >= percent * F.col("n"))
    visits = clustered.join(lists_of, "shingle").where((F.col("target") >= F.col("cluster")) & fits).groupBy("rep", "cluster", "target").agg(F.count("*").alias("c")).where(F.col("c") >= shared_lists).select("rep", "cluster", "target")
    visits = materialise(visits)
    routed = routes(visits, block_rows)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        rep, target, piece, salt, resident, sets = zip(*out, strict=True)
        return pa.record_batch({"rep": pa.array(rep, pa.int64()), "target": pa.array(target, pa.int64()), "part": pa.array(piece, pa.int32()), "salt": pa.array(salt, pa.int32()), "resident": pa.array(resident, pa.bool_()), "shingles": lists(list(sets), pa.int64())})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            for part in sliced(batch, 200):
                out, size = [], 0
                for r, text, to in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    s = shingles(text).view(np.int64)
                    for t in to:
                        out.append((r, t["target"], t["target_part"], t["salt"], t["resident"], s))
                        size += len(s)
                        if size > SENT:
                            yield packed(out)
                            out, size = [], 0
                if out:
                    yield packed(out)

    candidates = texts.join(routed.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"), "to")
    sets = candidates.mapInArrow(sent, "rep long, target long, part int, salt int, resident boolean, shingles array<long>")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from streamed_links(batches, percent)

    links = sets.repartition("target", "part", "salt").sortWithinPartitions("target", "part", "salt", F.desc("resident"), "rep").mapInArrow(linked, "a long, b long")
    # Different texts under one doc_id are one document.
    worded = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "whole")
    twice = worded.groupBy("doc_id").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("lo <> hi").select("doc_id")
    same = worded.join(twice, "doc_id").join(reps.select("whole", "rep"), "whole").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(same))
    label = reps.select("whole", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("whole", F.coalesce("component", "rep").alias("label"))
    return rows.select("doc_id", "n", "whole").join(label, "whole", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """`docs` with one row of each group of linked texts: that of the smallest doc_id.

    Rows that repeat a doc_id are one document, of which one row stays. Rows with a null doc_id cannot be named
    and stay, as do texts without words.
    """
    found = ngram_join(docs, width, percent)
    dropped = materialise(found.where("doc_id <> component_id").select("doc_id").distinct())
    twice = materialise(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    if not twice.take(1):
        return kept
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
