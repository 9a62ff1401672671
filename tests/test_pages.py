from pyspark.sql import functions as F

from ledgerloom.operators import pages as P
from ledgerloom.operators import rows as W
from ledgerloom.sources import readers

FILL = " ".join(["word"] * 100)


def pages(spark, texts, doc=1):
    return spark.createDataFrame([(doc, n, t) for n, t in texts.items()], "document_id long, page_number int, text string")


def sectioned(spark, texts):
    return P.assign_sections(P.classify_pages(pages(spark, texts)))


def test_detect_order_and_types(spark):
    texts = {1: "Consolidated Balance Sheets\nStatements of Cash Flows " + FILL, 2: FILL, 3: "Note 12\n" + FILL,
             4: "STATEMENTS OF STOCKHOLDERS’ EQUITY " + FILL, 5: "x " * 1500 + "balance sheet"}
    got = {}
    for r in P.detect_statements(pages(spark, texts)).collect():
        got.setdefault(r["page_number"], []).append((r["rank"], r["statement_type"], r["matched_text"]))
    assert sorted(got[1]) == [(1, "balance_sheet", "Consolidated Balance Sheets"), (2, "cash_flow", "Statements of Cash Flows")]
    assert got[2] == [(1, "other", "")] and got[3][0][1] == "notes"
    assert got[4][0][1:] == ("equity_statement", "STATEMENTS OF STOCKHOLDERS' EQUITY") and got[5] == [(1, "other", "")]


def expand(spark, texts, **kw):
    return {(r["section"], r["page_number"]) for r in P.expand_continuation(sectioned(spark, texts), **kw).collect()}


def test_continuation_stops(spark):
    heading = "Balance Sheet\n" + FILL
    texts = {1: heading, 2: FILL, 3: FILL, 4: "short", 5: FILL}
    assert expand(spark, texts) == {("balance_sheet", n) for n in (1, 2, 3)}  # scanned page 4
    texts = {1: heading, 2: FILL, 4: FILL}
    assert expand(spark, texts) == {("balance_sheet", 1), ("balance_sheet", 2)}  # page 3 missing
    texts = {1: heading, 2: "Note 3\n" + FILL, 3: "Income Statement\n" + FILL}
    assert expand(spark, texts) == {("balance_sheet", 1), ("balance_sheet", 2), ("income_statement", 3)}  # notes do not stop
    late = {1: heading, 2: FILL + " x" * 2000 + " cash flow statement"}
    assert expand(spark, late) == {("balance_sheet", 1)}
    assert expand(spark, late, foreign_heading=False) == {("balance_sheet", 1), ("balance_sheet", 2)}
    texts = {1: heading, **{n: FILL for n in range(2, 15)}}
    assert expand(spark, texts) == {("balance_sheet", n) for n in range(1, 10)}  # window of 8


def segment(spark, text, kind):
    p = pages(spark, {1: text}).withColumn("section", F.lit(kind))
    return P.segment_pages(p).first()["segment"]


def test_segments(spark):
    bs, cf, body = "Consolidated Balance Sheet\n", "Cash Flow Statement\n", "line of text\n" * 20
    text = bs + body + cf + body
    assert segment(spark, text, "balance_sheet") == bs + body
    assert segment(spark, text, "cash_flow") == cf + body
    assert segment(spark, body, "cash_flow") == body
    assert segment(spark, body + bs + body, "cash_flow") == body
    assert segment(spark, "tiny\n" + bs + body, "cash_flow") == ""
    assert segment(spark, bs + "tiny\n" + cf + body, "balance_sheet") == ""
    deep = "x" * 60 + " balance sheet\n" + body
    assert segment(spark, deep, "balance_sheet") == deep  # too far into its line to be a heading


def test_merge_labels_and_reroute(spark):
    s = sectioned(spark, {1: "scan", 2: "scan", 3: "scan"})
    labels = spark.createDataFrame([(1, 1, ["income_statement", "cash_flow"], 0.9), (1, 2, ["cash_flow"], 0.5)],
                                   "document_id long, page_number int, statement_types array<string>, label_confidence double")
    got = {r["page_number"]: (r["section_type"], r["secondary_section_type"]) for r in P.merge_page_labels(s, labels).collect()}
    assert got == {1: ("income_statement", "cash_flow"), 2: ("other", None), 3: ("other", None)}
    c = P.classify_pages(pages(spark, {1: FILL, 2: FILL})).withColumn("drawing_count", F.when(F.col("page_number") == 1, 201).otherwise(199))
    assert {r["page_number"]: r["classification"] for r in P.reroute_hybrid(c).collect()} == {1: "scanned", 2: "digital"}


def test_extract_lines(spark):
    text = "Particulars  2023  2022\n  401000 Fees (Note 4)   1,234  (567)\nTotal income   1,234.5  -\nno numbers here\n"
    got = {(r["raw_label"], r["year"]): (r["value"], r["note_ref"], r["is_subtotal"], r["indentation_level"]) for r in W.extract_lines(pages(spark, {1: text})).collect()}
    assert got == {("Fees (Note 4)", "2023"): (1234.0, "(Note 4)", False, 1), ("Fees (Note 4)", "2022"): (-567.0, "(Note 4)", False, 1),
                   ("Total income", "2023"): (1234.5, None, True, 0), ("Total income", "2022"): (None, None, True, 0)}


def test_parse_payloads(spark):
    good = 'Sure:\n```json\n{"rows":[{"raw_label":" Cash ","year_values":[{"year":"FY 2018-19","value":1},{"year":"2019","value":2}]},{"raw_label":" "}]}\n```'
    df = spark.createDataFrame([(1, good), (2, "no json"), (3, '{"rows": 5}')], "id int, payload string")
    rows = readers.parse_row_payloads(df).collect()
    assert [(r["id"], r["raw_label"], r["raw_values"], r["indentation_level"], r["is_subtotal"]) for r in rows] == [(1, "Cash", {"2019": 2.0}, 0, False)]


def test_read_pages_formats(spark, tmp_path):
    src = spark.createDataFrame([("d", ["one", "two"])], "document_id string, text array<string>")
    src.write.parquet(str(tmp_path / "p"))
    assert [(r["page_number"], r["text"]) for r in readers.read_pages(spark, str(tmp_path / "p")).orderBy("page_number").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("first\fsecond")
    got = readers.read_pages(spark, str(tmp_path / "t"), "text").orderBy("page_number").collect()
    assert [(r["document_id"], r["page_number"], r["text"]) for r in got] == [("a.txt", 1, "first"), ("a.txt", 2, "second")]
    spark.createDataFrame([("d", 3, "x")], "document_id string, page_number int, text string").write.json(str(tmp_path / "j"))
    assert readers.read_pages(spark, str(tmp_path / "j"), "json").first()["page_number"] == 3


def test_headings_over_lines_and_in_long_pages(spark):
    text = "Consolidated\nbalance sheet as at 2023\n" + "x" * 51 + "cash flow statement\n" + "y\n" * 30_000 + "’q’ Cash  flow\n\n\nstatement\nIncome statement balance sheet\n"
    df = pages(spark, {1: text, 2: None, 3: "", 4: "balance sheet"})
    got = {r.page_number: [(h.pos, h.statement_type) for h in r.h or []] for r in df.select("page_number", P.heading_lines(F.col("text")).alias("h")).collect()}
    late = 25 + 13 + 71 + 60_000  # the three lines before, with their ends
    assert got[1][:2] == [(0, "balance_sheet"), (13, "balance_sheet")] and got[2] == got[3] == [] and got[4] == [(0, "balance_sheet")]
    assert [k for _, k in got[1][2:]] == ["cash_flow", "balance_sheet"] and got[1][2][0] == text.index("’q’") and late > 0


def test_label_hits_take_the_longest_phrase(spark):
    rules = spark.createDataFrame([(0, "T1", "total assets", "a", 0.9), (1, "T1", "total assets net", "b", 0.9), (2, "T2", "net", "c", 0.9), (3, "T1", "cash", "d", 0.9), (4, "T2", "cash", "d", 0.9), (5, None, "assets", "e", 0.9), (6, "T2", "", "f", 0.9)],
                                  "rule_ord int, template_type string, rule_label string, canonical_field string, rule_confidence double")
    p = pages(spark, {1: "TOTAL  assets: net cash", 2: "total\nassets and subtotal assets", 3: "nettotal assets2", 4: None, 5: ""})
    found = P.label_hits(p, P.label_phrases(rules)).collect()
    assert sorted((r.label, tuple(r.templates)) for r in found) == [("net", ("T2",)), ("total assets", ("T1",)), ("total assets net", ("T1",))]
    scored = P.score_templates(p, rules=rules).first()
    assert (scored.score, scored.template_type) == (0.666667, "T1") and P.score_templates(p).first().template_type == "T0_unknown"


def test_label_hits_meet_whole_phrases_only(spark, capsys):
    """Words that begin many phrases are not paired with each of them."""
    rules = spark.createDataFrame([(f"T{i % 3}", f"net w{i}") for i in range(300)] + [("T9", "net w1 more"), ("T9", "sole")], "template_type string, rule_label string")
    p = spark.createDataFrame([(1, 1, "Net w1 more, net w2; sole net"), (1, 1, "other"), (2, 1, "net w1 net w1 sole sole"), (2, 2, "")], "document_id long, page_number int, text string")
    found = P.label_hits(p, P.label_phrases(rules))
    assert {(r.document_id, r.label) for r in found.collect()} == {(1, "net w1 more"), (1, "net w2"), (1, "sole"), (2, "net w1"), (2, "sole")} and found.count() == 5
    found.explain()
    assert "words" not in capsys.readouterr().out, "phrases are met by their text, not looked through by their first word"
