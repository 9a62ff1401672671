"""Fill-in-middle: each text is cut into prefix, middle and suffix and written with the middle last.

Cuts fall between units (lines with their line ends, by default). A text's UTF-8 bytes are seen as blocks of fixed size; a
Fenwick tree over the blocks holds how many unit ends and code points each node's blocks have. The block of a cut
is found by binary-lifting descent in the tree, the place inside it by a look at that one block; the same tree then
gives the code points before the cut. The trees of all texts of an Arrow batch lie in one array, and all cuts
descend together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import sliced
from ledgerloom.session import tune

#: Bytes of a block; texts and bytes whose trees are built at once.
BLOCK, ROWS, BYTES = 512, 2000, 8 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Plan(NamedTuple):
    """What the transformation does: seed of the row's hash, share of texts cut and of those written suffix first."""

    seed: int = 7
    rate: int = 100  # per cent
    spm: int = 50  # per cent
    unit_end: str = "\n"  # one ASCII character that ends a unit
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marks(self) -> tuple[bytes, bytes, bytes]:
        """The marks as bytes, checked so that no mark can begin inside another or across its edge."""
        found = (self.prefix.encode(), self.suffix.encode(), self.middle.encode())
        if len(set(found)) < 3 or any(len(m) < 2 or m[:1] != found[0][:1] or m[:1] in m[1:] for m in found):
            raise ValueError("marks must differ, begin with one character and hold it nowhere else")
        if len(self.unit_end.encode()) != 1:
            raise ValueError("a unit ends with one ASCII character")
        return found


class Forest:
    """Fenwick trees over the blocks of several texts, which lie one after the other in `data`."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit_end: int, block: int = BLOCK) -> None:
        self.data, self.unit_end, self.block = data, unit_end, block
        self.begin, length = ends[:-1], np.diff(ends)
        self.blocks = -(-length // block)
        #: Place of each tree in the flat arrays; node i (from 1) of text t is at root[t] + i.
        self.root = np.concatenate(([0], np.cumsum(self.blocks)))[:-1]
        total = int(self.blocks.sum())
        owner = np.repeat(np.arange(len(length)), self.blocks)
        number = np.arange(total) - self.root[owner]  # of the block in its text, from 0
        starts = self.begin[owner] + number * block
        node = number + 1
        low = node - (node & -node)  # the node covers blocks low .. number

        def tree(mark: np.ndarray) -> np.ndarray:
            counts = np.add.reduceat(mark, starts, dtype=np.int64) if total else np.empty(0, np.int64)
            before = np.concatenate(([0], np.cumsum(counts)))
            return np.concatenate(([0], before[1:] - before[self.root[owner] + low]))

        self.units = tree(data == unit_end)
        self.points = tree((data & 0xC0) != 0x80)

    def total(self, tree: np.ndarray) -> np.ndarray:
        """Sum of each text's blocks, along the path of its last node."""
        out, node = np.zeros(len(self.blocks), np.int64), self.blocks.copy()
        while (live := node > 0).any():
            out[live] += tree[(self.root + node)[live]]
            node = np.where(live, node & (node - 1), 0)
        return out

    def cut(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points of each text up to its rank-th unit end; beyond the last one, up to the text's end."""
        node, units, points = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        step = 1 << max(0, int(self.blocks.max(initial=0)).bit_length() - 1)
        while step:
            at = np.minimum(node + step, self.blocks)
            seen = units + np.where(node + step <= self.blocks, self.units[self.root + at], 0)
            down = (node + step <= self.blocks) & (seen < rank)
            points += np.where(down, self.points[self.root + at], 0)
            node, units = np.where(down, at, node), np.where(down, seen, units)
            step >>= 1
        place = np.zeros(len(rank), np.int64)
        for t in np.flatnonzero(rank > 0).tolist():
            first, stop = int(node[t]) * self.block, int(self.begin[t + 1] if t + 1 < len(rank) else len(self.data)) - int(self.begin[t])
            if first >= stop:  # fewer unit ends than asked for
                place[t] = stop
                continue
            inside = self.data[self.begin[t] + first : self.begin[t] + min(first + self.block, stop)]
            length = int(np.flatnonzero(inside == self.unit_end)[rank[t] - units[t] - 1]) + 1
            place[t] = first + length
            points[t] += int(((inside[:length] & 0xC0) != 0x80).sum())
        return place, points


def _columns(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with a bounded number of rows and, but for a single longer text, of bytes."""
    for part in sliced(batch, ROWS):
        size = np.cumsum(pc.binary_length(part.column("__text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < part.num_rows:
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + BYTES, "right")))
            yield part.slice(first, last - first)
            first = last


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """`docs` with n, form, prefix_chars, middle_chars and output; columns of those names are replaced.

    `docs` has doc_id and text. A unit is a maximal run without `unit_end`, with the one that ends it; `n` counts
    them. With h1 to h4 the first four 8-digit groups of the hex SHA-256 of `<seed>:<doc_id>`, the prefix ends after
    the smaller and the middle after the larger of h1 % (n+1) and h2 % (n+1) units. `form` is plain for empty texts,
    those that hold a mark and those with h3 % 100 >= rate; else spm if h4 % 100 < spm, else psm. Null texts are empty
    ones, a null doc_id is hashed as no characters; rows that repeat are cut alike. Code points are bytes that do not continue one, so
    malformed text keeps its bytes. No rows give no rows.
    """
    tune(docs.sparkSession)
    marks = plan.marks()
    names = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashed = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]
    given = docs.select(*names, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("__text"), *hashed)
    schema = docs.select(*names).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "binary")
    (rate, spm, end), (p, s, m), held = (plan.rate, plan.spm, plan.unit_end.encode()), marks, re.compile(b"|".join(map(re.escape, marks)))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _columns(batch):
                texts = part.column("__text").to_pylist()
                ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                forest = Forest(np.frombuffer(b"".join(texts), np.uint8), ends, end[0])
                n = forest.total(forest.units) + np.array([bool(t) and not t.endswith(end) for t in texts], np.int64)
                h1, h2, h3, h4 = (part.column(f"__h{k}").to_numpy() for k in range(1, 5))
                a, b = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
                (first, before), (last, upto) = forest.cut(a), forest.cut(b)
                form, output = [], []
                for text, x, y, share, order in zip(texts, first.tolist(), last.tolist(), h3.tolist(), h4.tolist(), strict=True):
                    if not text or share % 100 >= rate or held.search(text):
                        form.append(PLAIN)
                        output.append(text)
                    elif order % 100 < spm:
                        form.append(SPM)
                        output.append(b"".join((s, text[y:], p, text[:x], m, text[x:y])))
                    else:
                        form.append(PSM)
                        output.append(b"".join((p, text[:x], s, text[y:], m, text[x:y])))
                plain = np.array([f == PLAIN for f in form], bool)
                out = {"n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(before, pa.int64(), mask=plain), "middle_chars": pa.array(upto - before, pa.int64(), mask=plain), "output": pa.array(output, pa.binary())}
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *out.values()], names=[*names, *out])

    return given.mapInArrow(written, schema).withColumn("output", F.col("output").cast("string"))


def restore(made: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """`made` with the column restored: the text that `output` and `form` were made from.

    Other columns stay; one named restored is replaced. A null output or form, and one without its marks, gives null.
    """
    p, s, m = plan.marks()
    names = [c for c in made.columns if c not in ("restored", "__output")]
    schema = made.select(*names).schema.add("restored", "binary")

    def text(output: bytes | None, form: str | None) -> bytes | None:
        if output is None or form is None or form == PLAIN:
            return output if form == PLAIN else None
        first, second = (p, s) if form == PSM else (s, p)
        at = output.find(second, len(first))
        end = output.find(m, at + len(second)) if at >= 0 else -1
        if end < 0 or not output.startswith(first):
            return None
        one, two, three = output[len(first) : at], output[at + len(second) : end], output[end + len(m) :]
        return one + three + two if form == PSM else two + three + one

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, ROWS):
                texts = [text(o, f) for o, f in zip(part.column("__output").to_pylist(), part.column("form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.binary())], names=[*names, "restored"])

    return made.select(*names, F.col("output").cast("binary").alias("__output")).mapInArrow(rebuilt, schema).withColumn("restored", F.col("restored").cast("string"))


def digests(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    made = restore(fill_in_middle(docs.select("doc_id", "text"), plan).drop("text"), plan)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


ORACLE = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
c AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT % (len(u) + 1) AS i, ('0x' || substr(x, 9, 8))::BIGINT % (len(u) + 1) AS j,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(u[1:least(i, j)], '') AS prefix, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS middle, array_to_string(u[greatest(i, j) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
