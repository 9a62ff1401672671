import math
import random
import re
import textwrap

import pytest

from ledgerloom.llm.licences import TEMPLATES, UNKNOWN, Model, learn, scan

SCHEMA = "doc_id long, text string, family string, words string"


def brute(text, model: Model):
    """Family and probability of each line by plain arithmetic."""
    out = []
    for n, line in enumerate((text or "").split("\n")):
        w = [x for x in re.split(r"[^a-z0-9+-]+", line.lower()) if x]
        terms = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))} & set(model.weights)
        s = list(model.intercepts)
        for t in terms:
            s = [a + b for a, b in zip(s, model.weights[t])]
        best = max(range(len(s)), key=lambda k: s[k])
        p = 1 / sum(math.exp(x - s[best]) for x in s)
        if terms and model.families[best] != UNKNOWN and p >= model.least:
            out.append((n, model.families[best], p))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_notices_are_found_and_plain_lines_are_not(spark, model):
    docs = [(k, f"Some first line of plain words.\n\n{t}\nThe end of it was near and the day was long.", "x", "y") for k, (_, t) in enumerate(TEMPLATES)]
    docs += [(100, None, None, None), (101, "", "", ""), (102, "The license of the driver is his to keep for free and the software is good.", "x", "y"), (103, ("many plain words here " * 20 + "\n") * 2000 + "Released under the MIT License.", "x", "y"), (None, "Licensed under CC BY-NC 4.0.", "x", "y"), (104, "Licensed under CC BY-NC 4.0.", "x", "y"), (104, "Licensed under CC BY-NC 4.0.", "x", "y")]
    rows = scan(spark.createDataFrame(docs, SCHEMA), model).collect()
    for k, (family, text) in enumerate(TEMPLATES):
        hits = [r for r in rows if r.doc_id == k]
        assert [(r.paragraph, r.family) for r in hits] == ([(2, family)] if family != UNKNOWN else []), text
        assert all(r.confirmed and r.similarity == 1 for r in hits)
    assert not [r for r in rows if r.doc_id in (100, 101, 102)]
    assert [(r.paragraph, r.family, r.template) for r in rows if r.doc_id == 103] == [(2000, "MIT", 3)]
    assert len([r for r in rows if r.doc_id == 104]) == 2 and len([r for r in rows if r.doc_id is None]) == 1
    assert scan(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_scores_equal_plain_arithmetic(spark, model):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.paragraph): (r.family, r.probability) for r in scan(table, model).collect()}
    want = {(r.doc_id, n): (f, p) for r in table.collect() for n, f, p in brute(r.text, model)}
    assert set(got) <= set(want) and got
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in got)
    text = {r.doc_id: r.text for r in table.collect()}
    named = {t.lower() for _, t in TEMPLATES[:1]} | {"released under the mit license.", "licensed under cc by-nc 4.0.", "this work is licensed under the gnu general public license, version 3."}
    assert {k for k in got} == {(i, n) for i, t in text.items() for n, line in enumerate(t.split("\n")) if line.strip().lower() in named}


def test_learning_from_an_empty_corpus(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = learn(empty)
    assert model.families[0] == UNKNOWN and 0.5 <= model.least < 1


def test_prefixed_and_wrapped_notices_may_fill_a_third_of_the_lines(spark):
    rng = random.Random(3)
    lexicon = [f"word{k}" for k in range(400)]
    wrapped = [f"# {t}" for t in textwrap.wrap(TEMPLATES[1][1], 70)[:-1]] + [f"// {TEMPLATES[0][1]} Jane Doe"]
    docs = []
    for k in range(600):
        plain = [" ".join(rng.choices(lexicon, k=9)) for _ in range(2 * len(wrapped))]
        docs.append((k, "\n".join(wrapped + plain), "x", "y"))
    rows = scan(spark.createDataFrame(docs, SCHEMA)).where("doc_id < 20").collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in rows} == {(k, n, "Apache-2.0") for k in range(20) for n in range(len(wrapped))}
