"""Language identification by string kernels: presence of blended n-grams, Nystroem landmarks, kernel ridge regression.

A text is the set of its character n-grams of 1 to 3 letters (lower-cased, other characters count as one blank),
hashed to buckets; the kernel of two texts is the share of n-grams they have in common, |A n B| / sqrt(|A| |B|).
A bounded sample of labelled texts gives landmarks for every language; texts are mapped to the landmarks' span
(Nystroem) and one ridge regression per language is solved there. Scoring is one product of the texts' presence
matrix with the landmarks' and one with the weights, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, lists, row_arrays, sliced
from ledgerloom.session import materialise, tune

#: Labelled texts learnt from and landmarks, for each language at most.
TEXTS, LANDMARKS = 800, 32
#: Hash buckets of n-grams; longest n-gram; ridge.
BUCKETS, LONGEST, RIDGE = 1 << 18, 3, 1e-4
#: Texts scored by one matrix product.
ROWS = 128
#: Share of a text's n-gram occurrences that are known of some language; below it the pipeline rejects the text.
KNOWN = 0.5
#: Languages whose n-grams a task counts before it hands them on.
HELD_LANGUAGES = 16
#: Label of a text without letters, or when nothing could be learnt.
UNDETERMINED = "und"


class Model(NamedTuple):
    languages: list[str]
    column: np.ndarray  # bucket -> column of the landmarks' matrix, or -1
    landmarks: np.ndarray  # columns x landmarks, normalised
    weights: np.ndarray  # landmarks x languages
    sharpness: float


class Presence:
    """Distinct n-gram buckets of a text; None if the text has no letter."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.mark = np.zeros(BUCKETS, bool)

    def __call__(self, text: str | None) -> np.ndarray | None:
        every = self.occurrences(text)
        if every is None:
            return None
        self.mark[every] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found.astype(np.int32)

    def occurrences(self, text: str | None) -> np.ndarray | None:
        """The buckets of all n-grams of a text, repeated as they are."""
        if not text:
            return None
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[points]
        if not letter.any():
            return None
        points = np.where(letter, points, np.uint32(32))
        keep = np.ones(len(points), bool)
        keep[1:] = letter[1:] | letter[:-1]
        inner = points[keep]
        points = np.concatenate(([np.uint32(32)] if inner[0] != 32 else [], inner, [np.uint32(32)] if inner[-1] != 32 else [])).astype(np.uint32)
        code, found = np.zeros(len(points), np.uint32), []
        for n in range(1, LONGEST + 1):
            if len(points) < n:
                break
            code = code[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
            found.append((code * np.uint32(0x9E3779B1)) >> np.uint32(14))
        return np.concatenate(found)


def _sample(docs: DataFrame, texts: int) -> tuple[list[str], list[np.ndarray]]:
    """Languages and n-grams of at most `texts` distinct learning texts of each language, chosen by hash."""
    learning = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"))).select("lang", F.make_valid_utf8("text").alias("text"), F.pmod(F.xxhash64("text"), F.lit(2**32)).alias("h"))
    counts = {r.lang: r.c for r in learning.groupBy("lang").agg(F.approx_count_distinct("h").alias("c")).collect()}
    if not counts:
        return [], []
    limit = F.lit(0)
    for lang, c in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(2**32 * min(1.0, 1.2 * texts / max(1, c))))).otherwise(limit)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in batches:
            for part in sliced(batch, 1000):
                found = [presence(t) for t in part.column(1).to_pylist()]
                keep = [i for i, f in enumerate(found) if f is not None]
                yield pa.record_batch({"lang": part.column(0).take(keep), "h": part.column(2).take(keep), "grams": lists([found[i] for i in keep], pa.int32())})

    rows = learning.where(F.col("h") < limit).dropDuplicates(["lang", "h"]).mapInArrow(shown, "lang string, h long, grams array<int>").toArrow().combine_chunks().sort_by([("lang", "ascending"), ("h", "ascending")])
    langs = rows.column("lang").to_pylist()
    grams = [g for c in rows.column("grams").chunks for g in row_arrays(c, np.int32)]
    kept: dict[str, int] = {}
    chosen = []
    for i, lang in enumerate(langs):
        kept[lang] = kept.get(lang, 0) + 1
        if kept[lang] <= texts:
            chosen.append(i)
    return [langs[i] for i in chosen], [grams[i] for i in chosen]


def known_grams(docs: DataFrame) -> np.ndarray:
    """Marks the buckets of n-grams that some language shows in its learning texts, all of them.

    A language shows what its texts hold at least as often as if all buckets were alike, so that in tables of any size
    chance n-grams stay unknown. Equal texts count once.
    """
    learning = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"))).select("lang", F.make_valid_utf8("text").alias("text"), F.xxhash64("text").alias("h"))
    repeated = learning.groupBy("lang", "h").agg(F.count("*").alias("copies")).where("copies > 1")
    weighed = learning.join(repeated, ["lang", "h"], "left").select("lang", "text", F.coalesce("copies", F.lit(1)).cast("double").alias("copies"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence, counts = Presence(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                gram = np.flatnonzero(n)
                yield pa.record_batch({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram, pa.int32()), "n": pa.array(n[gram], pa.float64())})
            counts.clear()

        for batch in batches:
            for part in sliced(batch, 1000):
                for lang, text, copies in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if (found := presence.occurrences(text)) is None:
                        continue
                    if lang not in counts:
                        if len(counts) == HELD_LANGUAGES:
                            yield from flush()
                        counts[lang] = np.zeros(BUCKETS)
                    np.add.at(counts[lang], found, 1 / copies)
        yield from flush()

    grams = materialise(weighed.mapInArrow(counted, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    shown = np.zeros(BUCKETS, bool)
    shown[grams.join(totals, "lang").where(F.col("n") * BUCKETS >= F.col("total")).select("gram").distinct().toArrow().column("gram").to_numpy()] = True
    return shown


def _matrix(grams: list[np.ndarray], column: np.ndarray, width: int) -> np.ndarray:
    """Presence of the landmarks' n-grams, each row divided by the root of all n-grams of its text."""
    x = np.zeros((len(grams), width), np.float32)
    for row, g in zip(x, grams, strict=True):
        at = column[g]
        row[at[at >= 0]] = 1 / np.sqrt(len(g))
    return x


def learn(docs: DataFrame, texts: int = TEXTS, landmarks: int = LANDMARKS) -> Model | None:
    langs, grams = _sample(docs, texts)
    if not langs:
        return None
    languages = sorted(set(langs))
    place = np.array([languages.index(x) for x in langs])
    marks = np.concatenate([np.flatnonzero(place == k)[:landmarks] for k in range(len(languages))])
    buckets = np.unique(np.concatenate([grams[i] for i in marks]))
    column = np.full(BUCKETS, -1, np.int32)
    column[buckets] = np.arange(len(buckets))
    base = _matrix([grams[i] for i in marks], column, len(buckets)).T.copy()
    kernel = np.concatenate([_matrix(grams[i : i + 200], column, len(buckets)) @ base for i in range(0, len(grams), 200)]).astype(float)
    values, vectors = np.linalg.eigh(base.T.astype(float) @ base)
    keep = values > 1e-6 * values[-1]
    spread = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ spread
    # Each language weighs the same, however many texts it gave.
    weight = (1 / np.bincount(place, minlength=len(languages)))[place][:, None]
    target = (place[:, None] == np.arange(len(languages))).astype(float)
    solved = np.linalg.solve(phi.T @ (phi * weight) + RIDGE * np.eye(phi.shape[1]), phi.T @ (target * weight))
    outputs = phi @ solved
    chosen = np.arange(len(place)), place
    loss = {s: -np.mean(np.log(np.maximum(_shares(outputs, s)[chosen], 1e-12))) for s in (1, 2, 4, 8, 16, 32)}
    return Model(languages, column, base, (spread @ solved).astype(np.float32), min(loss, key=loss.get))


def _shares(outputs: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(sharpness * (outputs - outputs.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, texts: int = TEXTS, landmarks: int = LANDMARKS, keep: tuple[str, ...] = ("doc_id",), results: tuple[str, str, str] = ("lang_pred", "score", "known"), rate: bool = True) -> DataFrame:
    """The columns `keep` and `results` (lang_pred, score, known) for each row of `docs` (doc_id, text, lang; more are ignored).

    Null text or text without a letter: `und`, score 0, known 0. Rows with a null lang are predicted but not learnt
    from; with nothing to learn from, all are `und`. `known` is the share of a text's n-gram occurrences that its language or
    another shows in its learning texts (`known_grams`); null where it is not asked for (`rate` false). Bytes that are no
    UTF-8 count as replacement characters.
    """
    spark = tune(docs.sparkSession)
    learnt = learn(docs, texts, landmarks)
    shared = spark.sparkContext.broadcast(tuple(learnt) if learnt else None)
    grams = spark.sparkContext.broadcast(known_grams(docs) if learnt and rate else None)
    kept = docs.select(*keep)
    names = [*kept.columns, *results]
    # The text is sent once, whether it is kept or not.
    width = len(kept.columns)
    place = kept.columns.index("text") if "text" in kept.columns else width

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, presence = Model(*shared.value) if shared.value else None, Presence()
        for batch in batches:
            for part in sliced(batch, ROWS):
                texts = [t if t is None else t.decode("utf-8", "replace") for t in part.column(place).cast(pa.binary()).to_pylist()]
                found = [presence(t) for t in texts]
                langs, scores, known = [UNDETERMINED] * len(found), np.zeros(len(found)), np.zeros(len(found))
                rows = [i for i, f in enumerate(found) if f is not None] if model else []
                if rows:
                    x = _matrix([found[i] for i in rows], model.column, len(model.landmarks))
                    shares = _shares((x @ model.landmarks @ model.weights).astype(float), model.sharpness)
                    best = shares.argmax(axis=1)
                    scores[rows] = shares[np.arange(len(rows)), best]
                    if rate:
                        known[rows] = [grams.value[presence.occurrences(texts[i])].mean() for i in rows]
                    for i, k in zip(rows, best, strict=True):
                        langs[i] = model.languages[k]
                yield pa.record_batch([*part.columns[:width], pa.array(langs), pa.array(scores), pa.array(known) if rate else pa.nulls(len(found), pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", {results[0]} string, {results[1]} double, {results[2]} double"
    sent = [*keep] if place < width else [*keep, F.col("text").alias("__text")]
    return docs.select(*sent).mapInArrow(predicted, schema)


def keep_known(docs: DataFrame, known: float = KNOWN) -> DataFrame:
    """`docs` without the texts that have no letter or are unlike every learnt language."""
    rated = identify(docs, keep=tuple(docs.columns), results=("__lang", "__score", "__known"))
    return rated.where((F.col("__lang") != UNDETERMINED) & (F.col("__known") >= known)).select(*docs.columns)
