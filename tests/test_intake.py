import json

from ledgerloom.sources.intake import ingest_folder


def put(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(x if isinstance(x, str) else json.dumps(x) + "\n" for x in lines))


def status(outcomes):
    return {r.path.rsplit("/", 1)[1]: (r.status, r.n_lines, r.n_bad, r.n_rows) for r in outcomes.collect()}


def page(document_id, number=1, text="x"):
    return {"document_id": document_id, "page_number": number, "text": text}


def test_new_broken_repeated_and_seen_files(spark, tmp_path):
    base = tmp_path / "in box=1 ü"
    put(base, "a.json", [page(1), page(1, 2)])
    put(base / "sub", "b.json", [page(2), '{"document_id": 3, "te\n', page(4)])
    rows, outcomes, ledger = ingest_folder(spark, str(base))
    assert status(outcomes) == {"a.json": ("loaded", 2, 0, 2), "b.json": ("partial", 3, 1, 2)}
    assert sorted((r.document_id, r.page_number) for r in rows.collect()) == [(1, 1), (1, 2), (2, 1), (4, 1)] and ledger.count() == 2
    done = spark.createDataFrame(rows.collect(), rows.schema)
    put(base, "c.json", [page(1), page(2)])  # loaded already
    put(base, "d.json", ["no json\n", '{"page_number": 1}\n'])
    put(base, "e.json", ["\n"])
    put(base, "f.json", [page(9), page(1)])
    put(base, "g.json", [page(9), page(9, 2)])  # in f already
    kept = spark.createDataFrame(ledger.collect(), ledger.schema)
    rows, outcomes, ledger = ingest_folder(spark, str(base), kept, done)
    assert status(outcomes) == {"a.json": ("seen", 0, 0, 0), "b.json": ("seen", 0, 0, 0), "c.json": ("repeated", 2, 0, 0), "d.json": ("failed", 2, 2, 0), "e.json": ("empty", 0, 0, 0), "f.json": ("loaded", 2, 0, 1), "g.json": ("repeated", 2, 0, 0)}
    assert [(r.document_id, r.page_number) for r in rows.collect()] == [(9, 1)] and ledger.count() == 7
    kept = spark.createDataFrame(ledger.collect(), ledger.schema)
    put(base, "d.json", [page(10), page(11), page(12)])  # mended
    rows, outcomes, _ = ingest_folder(spark, str(base), kept)
    assert {k: v[0] for k, v in status(outcomes).items() if v[0] != "seen"} == {"d.json": "loaded"} and rows.count() == 3
    rows, outcomes, _ = ingest_folder(spark, str(base), ingest_folder(spark, str(base))[2])
    assert rows.count() == 0 and {v[0] for v in status(outcomes).values()} == {"seen"}
