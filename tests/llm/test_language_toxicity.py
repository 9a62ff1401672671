import random

import numpy as np

from ledgerloom.llm.language import identify, keep_known
from ledgerloom.llm.toxicity import DRIFT, learn, maximal_segments, tokens, toxicity

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    from ledgerloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op3_language_kernel"](spark, SF).join(docs, "doc_id").toPandas()
    out = rows[rows.held_out]
    assert len(rows) == docs.count() and (out.lang == out.lang_pred).mean() > 0.98
    assert rows.score.between(0, 1).all()


def test_language_edge_cases(spark):
    en, de = "the quick brown fox and the lazy dog with this that", "der schnelle braune fuchs und der faule hund nicht auf"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "s") for i in range(40)]
    odd = [(100, None, "en", None), (101, "", None, None), (102, "12 -- !", "fr", None), (103, "the dog " * 20_000, None, "x"), (None, de, None, None), (104, "чужой язык", None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "en" and got[None].lang_pred == "de" and got[104].known < 0.5
    kept = keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} | {103, None}
    assert {r.lang_pred for r in identify(df.withColumn("lang", df.lang.substr(9, 1)).where("lang <> ''")).collect()} <= {"und"}
    assert identify(df.where("false")).collect() == []


def brute_segments(scores):
    """Maximal segments by their definition: the best-scoring stretch, then both sides of it."""
    found = []

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (top is None or total > top[0] + 1e-9):
                    top = (total, i, j)
        if top:
            found.append((top[1], top[2], round(top[0], 6)))
            best(a, top[1])
            best(top[2] + 1, b)

    best(0, len(scores))
    return sorted(found)


def test_segment_scan_finds_all_maximal_segments():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = np.where(rng.random(40) < 0.3, rng.normal(0.5, 1.5, 40), DRIFT)
        marked = [(i, float(s)) for i, s in enumerate(scores) if s != DRIFT]
        got = [(a, b, round(s, 6)) for a, b, s in maximal_segments(marked, DRIFT)]
        assert got == brute_segments(scores.tolist())
    assert maximal_segments([], DRIFT) == []


def test_toxicity_learns_words_and_marks_passages(spark):
    rng = random.Random(2)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            words[20:20] = [rng.choice(["grobian", "lump", "schuft"]), rng.choice(plain), rng.choice(["grobian", "lump", "schuft"])]
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(toxic)))
    rows += [(900, None, None), (901, "", None), (902, "Lump! " * 50_000, None), (None, "w1 w2", None), (3, rows[3][1], 1.0)]
    labels += [(5, None), (None, 1), (7, 0), (7777, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity(docs, marks).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    truth = {i: t for i, t in labels if t is not None}
    assert np.mean([by_id[i].predicted == truth[i] for i in range(600)]) > 0.99
    hit = next(r for r in got if r.predicted and r.doc_id is not None and r.doc_id < 600 and r.passages)
    assert {tokens(rows[hit.doc_id][1])[hit.passages[0].first].decode(), tokens(rows[hit.doc_id][1])[hit.passages[0].last].decode()} <= {"grobian", "lump", "schuft"}
    assert by_id[902].predicted == 1 and by_id[900].predicted == by_id[901].predicted == 0 and by_id[900].passages == []
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert {r.score for r in toxicity(docs, marks.where("false")).collect()} == {0.0}
    assert toxicity(docs.where("false"), marks).collect() == []


def test_long_clean_texts_stay_next_to_short_ones(spark):
    rng = random.Random(6)
    parts = {"en": "bcdfghjklm", "ja": [chr(0x4E00 + k) for k in range(60)]}
    lexicon = {lang: ["".join(rng.choice(p) for _ in range(4)) for _ in range(3000)] for lang, p in parts.items()}
    rows = [(k, " ".join(rng.choices(lexicon[lang], k=6)), lang) for k in range(4000) for lang in [("en", "ja")[k % 2]]]
    long = [(10_000 + k, " ".join(rng.choices(lexicon[lang], k=2000)), None) for k, lang in enumerate(("en", "ja", "en", "ja"))]
    strange = [(20_000, "αβγδ εζηθ " * 50, None), (20_001, "ぁあぃい" * 3, None)]
    docs = spark.createDataFrame(rows + long + strange, "doc_id long, text string, lang string")
    assert {r.doc_id for r in keep_known(docs).where("doc_id >= 10000").collect()} == {r[0] for r in long}


def test_toxic_terms_count_groups_of_near_copies(spark):
    rng = random.Random(9)
    plain = [f"w{k}" for k in range(2000)]
    rows, labels = [], []
    for i in range(900):
        words = rng.sample(plain, 40)
        toxic = i % 3 == 0
        if toxic:
            words[10:10] = ["grobe", "dumme", "kerle"]  # the phrase of texts that differ
        if rng.random() < (0.3 if toxic else 0.9):
            words.append("mild")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    copied = [f"copy{k}x" for k in range(60)]
    rows += [(1000 + i, " ".join([*copied[:30], plain[i], *copied[30:]])) for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    model, _ = learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odds = lambda w: model.words.get(w) or max((model.beginnings[w[:n]] for n in (4, 5, 6, 7) if w[:n] in model.beginnings), key=abs, default=0)
    assert min(odds(w) for w in (b"grobe", b"dumme", b"kerle")) > 2
    # About 90 of 16,000 toxic and 540 of 24,000 other words, drawn to the middle by the prior.
    assert -1.5 < odds(b"mild") < -1
    assert not any(w.startswith(b"copy") for w in (*model.words, *model.beginnings))
