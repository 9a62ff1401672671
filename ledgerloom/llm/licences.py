"""Licence scans: a paragraph classifier over word n-grams, with an unknown class, confirmed against templates.

Fragments of licence notices, and a bounded sample of the corpus's paragraphs as unknowns, train a multinomial
logistic regression with sparse (L1) weights over word uni- and bigrams. What resembles a licence's template is no unknown.
All other paragraphs of the corpus say which n-grams are too common for features and set the probability a family
needs. A paragraph is scored by looking its n-grams up in the weights; one without any weighted
word has the intercepts' scores, which are unknown, so that no more than a word test is spent on it. What a template of
the predicted family resembles enough is confirmed; what resembles none of them is unknown too. DataFrame functions only; documents are never exchanged.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import materialise, tune

#: Paragraphs of the corpus sampled as unknowns, about; half of them train.
UNKNOWNS = 4000
#: Share of n-grams' presence among unknowns above which one is no feature; share of unknowns that may pass.
COMMON, PASSING = 0.005, 0.001
#: Words in the fragments of notices; least similarity of a confirmed prediction, and of one that is kept; n-grams a
#: similarity is taken over at least.
FRAGMENTS, SIMILAR, SUSPECTED, LEAST = (6, 10, 16), 0.8, 0.4, 3
UNKNOWN = "unknown"
#: Notices by licence family, as their licensors word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("AGPL", "This program is licensed under the GNU Affero General Public License as published by the Free Software Foundation."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide under CC0 1.0."),
    (UNKNOWN, "All rights reserved. No part of this publication may be reproduced without prior permission of the publisher."),
    (UNKNOWN, "Use of this site is subject to our terms of service and privacy policy."),
    (UNKNOWN, "A driving license is required. The license fee is due every year and the license may be revoked."),
    (UNKNOWN, "See the file for details on permission to copy. Version 2.0 of the software was released in May."),
]


class Model(NamedTuple):
    families: list[str]
    intercepts: list[float]
    weights: dict[str, list[float]]  # n-gram -> a weight for each family; n-grams of weight 0 are left out
    marks: list[str]  # the rarest word of each n-gram
    least: float  # probability that a family needs


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9+-]+"), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def n_grams(tokens: Column) -> Column:
    return F.array_distinct(F.concat(tokens, bigrams(tokens)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): the lines of the documents that hold anything, numbered from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("paragraph", "text")).where("trim(text) <> ''")


def notices(spark: SparkSession) -> DataFrame:
    values = json.dumps([{"family": f, "text": t} for f, t in TEMPLATES])
    return spark.range(1).select(F.inline(F.from_json(F.lit(values), "array<struct<family:string,text:string>>")))


def template_grams(spark: SparkSession) -> list[dict]:
    """Number, family and distinct bigrams of each notice."""
    return [{"k": k, "f": r.family, "b": list(dict.fromkeys(r.b))} for k, r in enumerate(notices(spark).select("family", bigrams(words(F.col("text"))).alias("b")).collect())]


def similarity(template: Column, own: Column) -> Column:
    """Share of the shorter one's bigrams that a template and a paragraph both hold."""
    return F.size(F.array_intersect(template, own)) / F.greatest(F.lit(LEAST), F.least(F.size(template), F.size(own)))


def suspected(grams: list[dict], tokens: Column) -> Column:
    """Whether words are like the template of some family as much as predictions that are kept."""
    table = F.from_json(F.lit(json.dumps([g for g in grams if g["f"] != UNKNOWN])), "array<struct<k:int,f:string,b:array<string>>>")
    return _let(F.array_distinct(bigrams(tokens)), lambda own: F.exists(table, lambda t: similarity(t["b"], own) >= SUSPECTED))


def term_shares(docs: DataFrame, terms: list[str], grams: list[dict]) -> tuple[int, dict[str, float]]:
    """Paragraphs of the corpus unlike every licence's template, and the share of them that hold each of `terms`."""
    pairs = [t for t in terms if " " in t]
    singles, first, second = [t for t in terms if " " not in t], sorted({t.split(" ")[0] for t in pairs}), sorted({t.split(" ")[1] for t in pairs})
    places = lambda w: F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
    near = lambda w: F.filter(places(w), lambda i: F.get(w, i).isin(first) & F.get(w, i + 1).isin(second))
    both = lambda w: F.array_distinct(F.filter(F.transform(near(w), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))), lambda t: t.isin(pairs)))
    # Two bigrams of templates at least are needed to be like one: few paragraphs are compared. The empty term counts paragraphs.
    shown = lambda w, b: F.when((F.size(b) > 1) & suspected(grams, w), F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("")), b, F.array_distinct(F.filter(w, lambda x: x.isin(singles)))))
    held = _let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, _let(both(w), lambda b: shown(w, b))))
    counts = {r.term: r.n for r in paragraphs(docs).select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = counts.pop("", 0)
    return n, {t: c / n for t, c in counts.items()}


def learn(docs: DataFrame, unknowns: int = UNKNOWNS) -> Model:
    """Train on fragments of the notices and on sampled paragraphs; the threshold comes from all paragraphs."""
    return _learnt(docs, unknowns)[0]


def _learnt(docs: DataFrame, unknowns: int = UNKNOWNS) -> tuple[Model, DataFrame]:
    """The model, and the corpus's paragraphs that it finds likeliest of a known family, which set its threshold."""
    spark = tune(docs.sparkSession)
    notice = notices(spark)
    lines = docs.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0
    share = min(1.0, unknowns / max(1, lines))
    chosen = lambda: (F.pmod(F.xxhash64("doc_id", "paragraph", "text"), F.lit(2**32)) < int(share * 2**32)) & (F.pmod(F.xxhash64("text"), F.lit(2)) == 0)
    drawn = paragraphs(docs).where(chosen()).select(words(F.col("text")).alias("words"))
    grams = template_grams(spark)
    drawn = materialise(materialise(drawn.where("size(words) > 0")).where(~suspected(grams, F.col("words"))))

    token = notice.select("family", words(F.col("text")).alias("w"))
    cut = token.select("family", "w", F.explode(F.array(*(F.lit(n) for n in FRAGMENTS))).alias("n")).select("family", "w", "n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.col("n") + 1), F.lit(2))).alias("at"))
    # A fragment of a few words names no family: short notices count whole, and each as often as long ones do.
    fragments = cut.select("family", F.slice("w", F.col("at"), F.col("n")).alias("words")).unionByName(token.select("family", F.explode(F.array_repeat(F.col("w"), 10)).alias("words")))
    # The words of a notice backwards are no notice: n-grams have to carry the weight.
    fragments = fragments.unionByName(cut.select(F.lit(UNKNOWN).alias("family"), F.reverse(F.slice("w", F.col("at"), F.col("n"))).alias("words")))
    train = materialise(fragments.unionByName(drawn.select(F.lit(UNKNOWN).alias("family"), "words")).withColumn("terms", n_grams(F.col("words"))))
    terms = [r.term for r in train.where(F.col("family") != UNKNOWN).select(F.explode("terms").alias("term")).distinct().orderBy("term").collect()]
    n, shares = term_shares(docs, terms, grams)
    vocabulary = [t for t in terms if shares.get(t, 0.0) <= COMMON]
    families = [UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES if f != UNKNOWN)]
    counts = {r.family: r["count"] for r in train.groupBy("family").count().collect()}
    number = F.lit(0)
    weight = F.lit(1.0)
    for k, f in enumerate(families):
        number = F.when(F.col("family") == f, k).otherwise(number)
        weight = F.when(F.col("family") == f, (4.0 if f == UNKNOWN else 1.0) * 100 / max(1, counts.get(f, 0))).otherwise(weight)
    rows = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features").setBinary(True).transform(train.withColumn("label", number.cast("double")).withColumn("weight", weight))
    fitted = LogisticRegression(weightCol="weight", family="multinomial", regParam=5e-4, elasticNetParam=1.0, maxIter=40, standardization=False).fit(rows.select("features", "label", "weight").coalesce(2))
    matrix = fitted.coefficientMatrix.toArray()
    weights = {t: [float(x) for x in matrix[:, k]] for k, t in enumerate(vocabulary) if abs(matrix[:, k]).max() > 1e-6}
    marks = sorted({min(t.split(" "), key=lambda w: (shares.get(w, 0.0), w)) for t in weights})
    model = Model(families, [float(x) for x in fitted.interceptVector], weights, marks, 0.0)
    reached = materialise(scored(paragraphs(docs).withColumn("__trains", chosen()), words(F.col("text")), model).drop("text"))
    others = materialise(reached.where(~F.col("__trains") & ~suspected(grams, F.col("__words"))).select("probability"))
    passing = max(0.0, 1 - PASSING * max(1, n - drawn.count()) / max(1, others.count()))
    least = others.agg(F.percentile_approx("probability", F.lit(min(1.0, passing)), F.lit(10_000))).first()[0]
    model = model._replace(least=max(0.5, min(0.95, least or 0.0)))
    return model, reached.where(F.col("probability") >= model.least).drop("__trains")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scored(rows: DataFrame, tokens: Column, model: Model) -> DataFrame:
    """The rows whose words are likeliest of a known family, with words, family and probability."""
    if not model.weights:
        return rows.select("*", tokens.alias("__w"), F.lit(None).cast("string").alias("family"), F.lit(0.0).alias("probability")).where("false").withColumnRenamed("__w", "__words")
    table = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    start = F.array(*(F.lit(x) for x in model.intercepts))
    families = F.array(*(F.lit(f) for f in model.families))
    named = list(model.weights)
    total = lambda w: F.aggregate(F.filter(n_grams(w), lambda t: t.isin(named)), start, lambda s, t: F.zip_with(s, F.element_at(table, t), lambda a, b: a + b))
    share = lambda s, m: 1 / F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - m))
    chosen = lambda w, s: _let(F.array_max(s), lambda m: F.struct(w.alias("words"), F.get(families, F.array_position(s, m).cast("int") - 1).alias("family"), share(s, m).alias("probability")))
    result = _let(tokens, lambda w: F.when(F.exists(w, lambda x: x.isin(model.marks)), _let(total(w), lambda s: chosen(w, s))))
    # An explode evaluates its argument once, where a filter would repeat it.
    keep = F.filter(F.array(result), lambda r: (r["family"] != UNKNOWN) & (r["probability"] >= model.least))
    return rows.select("*", F.explode(keep).alias("__r")).select(*rows.columns, F.col("__r.words").alias("__words"), F.col("__r.family").alias("family"), F.col("__r.probability").alias("probability"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, template, similarity, confirmed): the paragraphs of a licence family.

    `docs` has doc_id and text; other columns are ignored. Paragraphs are lines, counted from 0 with the empty ones.
    Those the classifier finds unknown, of no family with the threshold's probability, or like no template of the
    family found give no row; null and empty texts have none. `template` is the notice of the family most alike, `similarity` the share of the shorter one's
    bigrams that both hold, `confirmed` whether that is enough. Rows that repeat give their paragraphs again.
    """
    spark = tune(docs.sparkSession)
    found = _learnt(docs)[1] if model is None else scored(paragraphs(docs), words(F.col("text")), model)
    grams = template_grams(spark)
    table = F.from_json(F.lit(json.dumps(grams)), "array<struct<k:int,f:string,b:array<string>>>")
    own = F.array_distinct(bigrams(F.col("__words")))
    alike = F.transform(F.filter(table, lambda t: t["f"] == F.col("family")), lambda t: F.struct(similarity(t["b"], own).alias("similarity"), (-t["k"]).alias("k")))
    best = found.withColumn("best", F.array_max(alike)).where(F.col("best.similarity") >= SUSPECTED)
    return best.select("doc_id", "paragraph", "family", "probability", (-F.col("best.k")).alias("template"), F.col("best.similarity").alias("similarity"), (F.col("best.similarity") >= SIMILAR).alias("confirmed"))
