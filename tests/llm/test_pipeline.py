import corpus_pipeline
from ledgerloom.llm.ngram_join import ngram_join
from ledgerloom.session import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_the_given_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], sf_dir)))
        assert kept[-1].columns[:5] == docs.columns and (name == "sharding") == (len(kept[-1].columns) > 5)
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert ids[1] == ids[0]  # every document of the table has a language
    groups = {r.doc_id: r.component_id for r in ngram_join(kept[1]).collect()}
    assert ids[2] == sorted(set(groups.values()))
    items = {" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    holds = {r.doc_id for r in kept[2].collect() if any(i in " ".join(r.text.split()) for i in items)}
    assert holds <= set(ids[2]) - set(ids[3]) and len(set(ids[2]) - set(ids[3])) <= len(holds) + 3
    assert set(ids[4]) == set(ids[3]) and ids[5] == ids[4]


def test_stages_take_nulls_and_nothing(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the words of a text and more", None, None, 5), (3, "the words of another text here", "en", "s", 1)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, "/root/testdata/sf0.001"))
        assert {r.doc_id for r in docs.collect()} == ({None, 3} if part else set())


def test_near_duplicates_reach_down_to_four_fifths(spark):
    base, more = [f"w{k}" for k in range(120)], [f"v{k}" for k in range(200)]
    rows = [(1, base), (2, base + more[:24]), (3, base[:100]), (4, [f"x{k}" for k in range(120)]), (5, base + more[100:140])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], SCHEMA)
    # 116 shingles of 5 words against 140, 96 and 156: 0.83, 0.83 and 0.74.
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 4, 5}
