import hashlib
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm.line_runs import Runs, digests, drop_lines, entries, repeated, seen
from ledgerloom.session import materialise

SPACE = " \t\n\x0b\f\r"
COMMON = "This Line Is Repeated In Very Many Of The Documents"


def plain(rows, least_chars, least_docs):
    """(doc_id, text left, lines, dropped) of each row, by a table of all lines."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    owner = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(k) >= least_chars and len(ids) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in owner or owner[key(x)] == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return Counter(out)


def documents():
    rows = [(i, f"{COMMON}\nown line of document number {i} that nobody repeats") for i in range(60)]
    rows += [(100 + i, f" \t{COMMON.upper()}\r\n\nshort\n{COMMON}\n{'é' * 39}\n{'é' * 40}\n") for i in range(7)]  # twice in a text, other case, ends
    rows += [(200 + i, "\n".join(f"block line {k} of a text that comes several times" for k in range(40)) + ("\n" if i % 2 else "")) for i in range(6)]
    rows += [(300 + i, "held by only four documents, so every line of it stays") for i in range(4)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (None, f"{COMMON}\nno id"), (None, "another row without an id, held by only four documents"), (5, f"{COMMON}\nagain the id five"), (5, f"{COMMON}\nagain the id five")]
    return rows + [(500 + i, "\n".join(["x" * 50, "İstanbul İ line that does not change its case by ASCII rules", "y" * 39] * 30)) for i in range(5)]


@pytest.mark.parametrize(("batches", "fanout"), [(6, 2), (1, 2), (7, 3), (9, 2)])
def test_lines_left_equal_a_plain_table(spark, batches, fanout):
    rows = documents()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, n_lines string, owner string").repartition(5)
    got = drop_lines(df, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "owner", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == plain(rows, 40, 5)


def test_batches_in_any_order_and_levels(spark):
    rows = documents()
    lines = materialise(entries(spark.createDataFrame(rows, "doc_id long, text string"), 20, 8))
    want = {(r.h1, r.h2): (r.docs, r.owner) for r in seen(lines).collect()}
    for order in (range(8), reversed(range(8)), (3, 7, 0, 5, 1, 6, 2, 4)):
        runs = Runs(spark, 5, 2)
        for k in order:
            runs.add(seen(lines.where(f"batch = {k}")))
        assert [len(level) for level in runs.levels] == [0, 0, 0, 1]  # eight batches are one run of the third level
        got = {(r.h1, r.h2): (r.docs, r.owner) for r in runs.merged().collect()}
        assert got.keys() == want.keys()
        for key, (docs, owner) in want.items():
            assert got[key][1] == owner and (got[key][0] == docs if docs < 5 else got[key][0] >= 5)
        runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    assert repeated(materialise(lines, partition_by=("batch",)), 5, 8).count() == sum(d >= 5 for d, _ in want.values())


def test_settled_keys_are_not_added_again(spark):
    batch = lambda ids: seen(spark.createDataFrame([(1, 2, i) for i in ids] + [(3, ids[0], ids[0])], "h1 long, h2 long, doc_id long"))
    runs = Runs(spark, 5, 9)
    runs.add(batch(range(90, 96)))
    runs.add(batch(range(10, 16)))
    assert spark.table(runs.levels[0][1]).count() == 1  # only the key of its own
    runs.add(batch(range(100, 103)))
    assert {(r.h1, r.docs, r.owner) for r in runs.merged().where("h1 = 1").collect()} == {(1, 9, 102)}
    runs.close()


def test_no_rows_and_digests(spark):
    df = spark.createDataFrame([(1, None), (2, "é\n")], "doc_id long, text string")
    assert drop_lines(df.where("false")).collect() == []
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in digests(df).collect()} == {(1, 1, 0, hashlib.sha256(b"").hexdigest()), (2, 2, 0, hashlib.sha256("é\n".encode()).hexdigest())}
