"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Counts: one pass over all texts gives, per word, how many texts of the corpus, of the toxic and of the other learning
documents hold it. Words and word beginnings get the log-odds of both classes under Dirichlet priors whose shape is the
corpus and whose weight is a share of each class (Monroe, Colaresi and Quinn); those that stand out make the
model. Near copies of one toxic text would make all its words stand out, so that the toxic texts of a term that
stands out as toxic count once for each group of near copies. Scan: every word scores its log-odds, all others a small negative drift; Ruzzo and Tompa's linear scan
finds all maximal segments. Karlin and Altschul's statistics turn a segment of score S in N words into
lambda * S - ln(K * N), from which E-values follow; the document's evidence is the sum over its significant
segments, and a logistic curve through all learning documents makes it a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, sliced
from ledgerloom.llm.ngram_join import ngram_join
from ledgerloom.session import materialise, tune

#: Labelled documents learnt from, at most: their ids and labels (16 bytes each) are broadcast.
LABELLED = 200_000
#: Distinct words a counting task holds before it hands them on.
HELD_WORDS = 300_000
#: Lengths of word beginnings that are terms of their own.
BEGINNINGS = (4, 5, 6, 7)
#: Weight of the prior as a share of a class's words; least |z| and log-odds of a term; score of any other word.
PRIOR_SHARE, LEAST_Z, LEAST_ODDS, DRIFT = 0.1, 4.0, 1.0, -0.2
#: Words of a shingle and least Jaccard similarity (per cent) of near copies among the toxic learning texts.
COPY_WIDTH, COPY_PERCENT = 5, 80
#: E-value up to which a segment counts as significant.
SIGNIFICANT = 1.0
ROWS = 2000
_SEPARATORS = bytes.maketrans(bytes(range(48)) + b":;<=>?@[\\]^_`{|}~\x7f", b" " * 66)


class Model(NamedTuple):
    words: dict[bytes, float]
    beginnings: dict[bytes, float]
    scale: float  # lambda
    offset: float  # ln K


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text: runs without ASCII white space or punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_SEPARATORS).split() if text else []


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text, in order; Ruzzo and Tompa's scan.

    `scores` holds the places and scores of the words that differ from `drift`, in order; the words between
    them only lower the running sum, so the scan visits the listed words alone.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, before = 0.0, -1
    for place, score in scores:
        total += drift * (place - before - 1)
        before = place
        if score <= 0:
            total += score
            continue
        first, low, high = place, total, total + score
        total = high
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
        found.append((first, place, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


def _labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, toxic) of the learning documents: one of each group of equal texts, at most about `limit`."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"))
    one = materialise(texts.join(known, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))
    share = min(1.0, limit / max(1, one.count()))
    return one.where(F.pmod(F.xxhash64("h"), F.lit(2**32)) < int(share * 2**32)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> tuple[Model, DataFrame]:
    """The terms' log-odds and the statistics' lambda; also the learning labels. K is set by `toxicity`."""
    tune(docs.sparkSession)
    labelled = materialise(_labelled(docs, labels, limit))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, toxic, other = Counter(), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(corpus)
            out = pa.record_batch({"word": pa.array(words, pa.binary()), "n": pa.array([corpus[w] for w in words], pa.int64()), "t": pa.array([toxic[w] for w in words], pa.int64()), "o": pa.array([other[w] for w in words], pa.int64())})
            for c in (corpus, toxic, other):
                c.clear()
            return out

        for batch in batches:
            for part in sliced(batch, ROWS):
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = set(tokens(text))  # a text that repeats a word counts once
                    corpus.update(words)
                    if label is not None:
                        (toxic if label else other).update(words)
                    if len(corpus) > HELD_WORDS:
                        yield flush()
        if corpus:
            yield flush()

    text = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(labelled), "doc_id", "left").select("text", "toxic")
    words = materialise(text.mapInArrow(counted, "word binary, n long, t long, o long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("o").alias("o")))
    sums = words.agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    total, toxic, other = (float(x or 0) for x in sums)
    if not toxic or not other:
        return Model({}, {}, 1.0, 0.0), labelled

    cut = F.explode(F.array(*(F.when(F.length(F.col("word").cast("string")) >= k, F.struct(F.substring(F.col("word").cast("string"), 1, k).cast("binary").alias("word"), F.lit(k).alias("k"))) for k in BEGINNINGS))).alias("c")
    begun = words.where("t + o > 0").select(cut, "n", "t", "o").where("c IS NOT NULL").groupBy("c.word", "c.k").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("o").alias("o"))
    terms = words.where("t + o > 0").select("word", F.lit(0).alias("k"), "n", "t", "o").unionByName(begun.select("word", "k", "n", "t", "o"))
    a_t, a_o = PRIOR_SHARE * toxic, PRIOR_SHARE * other

    def standing_out(found: DataFrame) -> DataFrame:
        y_t, y_o = F.col("t") + a_t * F.col("n") / total, F.col("o") + a_o * F.col("n") / total
        odds = F.log(y_t / (toxic + a_t - y_t)) - F.log(y_o / (other + a_o - y_o))
        found = found.where((y_t < toxic + a_t) & (y_o < other + a_o)).select("word", "k", "n", "t", "o", odds.alias("odds"), F.abs(odds / F.sqrt(1 / y_t + 1 / y_o)).alias("z"))
        return found.where((F.col("z") >= LEAST_Z) & (F.abs("odds") >= LEAST_ODDS))

    strong = materialise(standing_out(terms))
    leaning = strong.where("odds > 0").select("word", "k")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 500):
                ids, copies, texts = (part.column(i).to_pylist() for i in range(3))
                rows = [(w, i, c) for i, c, text in zip(ids, copies, texts, strict=True) for w in set(tokens(text))]
                if rows:
                    word, doc, copy = zip(*rows, strict=True)
                    yield pa.record_batch({"word": pa.array(word, pa.binary()), "doc_id": pa.array(doc, pa.int64()), "copies": pa.array(copy, pa.int64())})

    texts = materialise(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(labelled.where("toxic = 1")), "doc_id").select("doc_id", "text"))
    copies = ngram_join(texts, COPY_WIDTH, COPY_PERCENT).groupBy("doc_id").agg(F.min("component_id").alias("copies"))
    own = F.explode(F.array(F.struct("word", F.lit(0).alias("k")), *(F.when(F.length(F.col("word").cast("string")) >= k, F.struct(F.substring(F.col("word").cast("string"), 1, k).cast("binary").alias("word"), F.lit(k).alias("k"))) for k in BEGINNINGS))).alias("c")
    shown = texts.join(copies, "doc_id").select("doc_id", "copies", "text").mapInArrow(held, "word binary, doc_id long, copies long").select(own, "doc_id", "copies").where("c IS NOT NULL")
    shown = shown.select("c.word", "c.k", "doc_id", "copies").join(leaning, ["word", "k"], "left_semi").distinct()
    # The share of a term's toxic texts that are left when near copies count once.
    spread = shown.groupBy("word", "k", "copies").agg(F.count("*").alias("n")).groupBy("word", "k").agg((F.count("*") / F.sum("n")).alias("share"))
    terms = strong.join(spread, ["word", "k"], "left").withColumn("t", F.col("t") * F.coalesce("share", F.lit(1.0)))
    # Every term that stands out. A z of LEAST_Z takes several learning texts, so that LABELLED bounds the terms.
    rows = standing_out(terms).orderBy(F.desc("z"), "k", "word").collect()
    best = {(bytes(r.word), r.k): r for r in rows}
    whole = {w: r.odds for (w, k), r in best.items() if not k}
    begin = {w: (r.odds, r.z) for (w, k), r in best.items() if k}
    for w, k in list(best):  # a word speaks for itself where it stands out more than its beginnings do
        z = best[w, k].z
        if not k and any((b := begin.get(w.decode()[:n].encode())) and b[1] > z for n in BEGINNINGS):
            del whole[w]
    seen = Counter()
    for r in rows:
        seen[round(r.odds, 2)] += r.o / other if (r.k == 0 and bytes(r.word) in whole) or r.k == BEGINNINGS[0] else 0
    return Model(whole, {w: o for w, (o, _) in begin.items()}, _lambda(seen), 0.0), labelled


def _lambda(shares: dict[float, float]) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1, by bisection; the rest of the words score the drift."""
    rest = max(1e-9, 1 - sum(shares.values()))
    # A class that never shows a score still has it with the chance of half an occurrence.
    over = {s: max(p, 1e-7) for s, p in shares.items() if s > 0} or {1.0: 1e-7}
    under = {s: p for s, p in shares.items() if s <= 0}
    value = lambda x: sum(p * math.exp(min(500, x * s)) for s, p in over.items()) + sum(p * math.exp(x * s) for s, p in under.items()) + rest * math.exp(x * DRIFT) - 1
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, best, passages): every maximal segment that can be significant, with lambda * S."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)

        class Scores(dict):
            def __missing__(self, word: bytes) -> float | None:
                if len(self) > HELD_WORDS:
                    self.clear()
                value = m.words.get(word)
                if value is None:
                    text = word.decode("utf-8", "replace")
                    value = next((v for k in reversed(BEGINNINGS) if len(text) >= k and (v := m.beginnings.get(text[:k].encode())) is not None), None)
                self[word] = value
                return value

        scores = Scores()
        for batch in batches:
            for part in sliced(batch, ROWS):
                n, best, passages = [], [], []
                for text in part.column(1).to_pylist():
                    words = tokens(text)
                    marked = [(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s is not None]
                    found = maximal_segments(marked, DRIFT) if marked else []
                    n.append(len(words))
                    best.append(m.scale * max((s for *_, s in found), default=0.0))
                    passages.append([{"first": a, "last": b, "bits": m.scale * s} for a, b, s in found])
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("bits", pa.float64())]))
                yield pa.record_batch({"doc_id": part.column(0), "n_words": pa.array(n, pa.int64()), "best": pa.array(best, pa.float64()), "passages": pa.array(passages, kind)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_words long, best double, passages array<struct<first:int,last:int,bits:double>>")


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through (evidence, label, count), by Newton's method."""
    x, y, c = (np.array(v, float) for v in zip(*bins, strict=True))
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = c * p * (1 - p)
        gradient = np.array([(c * (y - p)).sum(), (c * (y - p) * x).sum() - 1e-3 * b])
        curve = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(curve, gradient)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
    return a, max(b, 1e-6)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, evidence, passages) for each row of `docs`.

    `docs` has doc_id and text, `labels` doc_id and toxic; other columns are ignored. Null and empty texts have no
    passage and get the score of no evidence. A document with contradicting labels counts as toxic; without
    labels of both kinds every score is the share of toxic labels (0 if none). `passages` are the significant
    segments: first and last word, normalised score, E-value. Equal texts get equal scores. Bytes that are no UTF-8 count
    as replacement characters.
    """
    tune(docs.sparkSession)
    docs = docs.withColumn("text", F.make_valid_utf8("text"))
    model, labelled = learn(docs, labels, limit)
    found = materialise(scanned(docs, model))
    learnt = found.join(labelled, "doc_id")
    # Gumbel's mean over clean documents with a segment: ln(K * N) + 0.5772.
    mean = learnt.where("toxic = 0 AND best > 0").agg(F.avg(F.col("best") - F.log("n_words"))).first()[0]
    offset = min(0.0, max(-7.0, mean - 0.5772)) if mean is not None else math.log(0.1)
    size = F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")) + offset
    passages = F.filter(F.transform("passages", lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), (p["bits"] - size).alias("score"), F.exp(size - p["bits"]).alias("e_value"))), lambda p: p["e_value"] <= SIGNIFICANT)
    rated = lambda df: df.withColumn("passages", passages).withColumn("evidence", F.aggregate("passages", F.lit(0.0), lambda s, p: s + p["score"] + 1))
    bins = [(r.x, r.toxic, r.c) for r in rated(learnt).groupBy((F.round(F.least("evidence", F.lit(100.0)) * 4) / 4).alias("x"), "toxic").agg(F.count("*").alias("c")).collect()]
    kinds = {y for _, y, _ in bins}
    if len(kinds) < 2:
        score = F.lit(1.0 if kinds == {1} else 0.0)
    else:
        a, b = _curve(bins)
        score = 1 / (1 + F.exp(-(F.lit(a) + b * F.least("evidence", F.lit(100.0)))))
    out = rated(found).withColumn("score", score)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "evidence", "passages")
