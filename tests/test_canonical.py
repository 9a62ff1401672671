import pytest
from pyspark.sql import functions as F

from ledgerloom import refdata as R
from ledgerloom.operators import canonical as C
from ledgerloom.operators import checks as K


def rules(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], R.RULE_SCHEMA)


def lookup(spark, labels, table, template="T1"):
    df = spark.createDataFrame([(template, x) for x in labels], "template_type string, normalized_label string")
    return {r["normalized_label"]: (r["canonical_field"], round(r["confidence"], 4)) for r in C.dictionary_lookup(df, table).collect()}


def test_lookup_tiers(spark):
    t = rules(spark, [(None, "total assets", "any", 0.99), ("T1", "total assets", "own", 0.9), ("T2", "cash", "other", 0.9), (None, "borrowings", "debt", 0.5)])
    got = lookup(spark, ["total assets", "cash", "long term borrowings", "", "nothing"], t)
    assert got == {"total assets": ("own", 0.9), "cash": (None, 0.0), "long term borrowings": ("debt", 0.4), "": ("any", 0.84), "nothing": (None, 0.0)}
    assert lookup(spark, ["total assets"], t, "T3") == {"total assets": ("any", 0.99)}


def test_disambiguate(spark):
    df = spark.createDataFrame([(1, "interest income", "cash_flow", ["Investing"], "interest_income", 0.97), (2, "interest income", "cash_flow", ["Op"], "interest_income", 0.97),
                                (3, "total equity", "equity_statement", [], "total_equity", 0.99), (4, "other income", "balance_sheet", [], None, 0.0)],
                               "i int, normalized_label string, statement_type string, section_path array<string>, canonical_field string, confidence double")
    got = {r["i"]: (r["canonical_field"], r["confidence"], r["flag_for_review"]) for r in C.disambiguate(df).collect()}
    assert got == {1: ("interest_received_investing", 0.9, False), 2: ("interest_income", 0.75, True), 3: ("closing_equity", 0.88, False), 4: (None, 0.0, False)}


def test_tree(spark):
    rows = [(1, 1, "a", False, 40.0), (1, 2, "b", False, 60.3), (1, 3, "t", True, 100.0), (1, 4, "c", False, None), (1, 5, "u", True, 7.0), (1, 6, "v", True, 0.0), (1, 7, "d", False, 1.0)]
    df = spark.createDataFrame([(r[0], "bs", *r[1:]) for r in rows], "document_id int, statement_type string, extraction_id int, raw_label string, is_subtotal boolean, value double")
    got = {r["subtotal_id"]: (r["n_children"], r["sum_valid"]) for r in C.build_statement_tree(df).collect()}
    assert got == {3: (2, True), 5: (1, False), 6: (0, None), None: (1, None)}


def test_last_row_wins_even_when_null(spark):
    df = spark.createDataFrame([(1, 1, "f", 5.0), (1, 2, "f", None)], "document_id int, extraction_id int, canonical_field string, value double")
    assert C.canonical_map(df).first()["value"] is None


def run(spark, values, template="T1"):
    df = spark.createDataFrame([(1, template, k, v) for k, v in values.items()], "document_id int, template_type string, canonical_field string, value double")
    return {r["check_id"]: (r["status"], r["diff_pct"]) for r in K.run_validations(df).collect()}


def test_checks(spark):
    ok = run(spark, {"total_assets": 100.0, "total_liabilities": 60.0, "total_equity": 40.0, "cash_end": 10.0, "cash_start": 10.0})
    assert ok["V01"][0] == "passed" and ok["V02"][0] == "skipped" and ok["V05"][0] == "passed" and ok["V12"][0] == "skipped" and len(ok) == 13
    assert ok["V13"] == ("failed", 25.0)
    bad = run(spark, {"total_assets": 100.0, "total_liabilities": 60.0, "total_equity": 39.0, "cash_end": None, "cash_start": None})
    assert bad["V01"] == ("failed", pytest.approx(0.01)) and bad["V05"][0] == "skipped"
    eq = {"closing_equity": 110.0, "opening_equity": 100.0, "net_income": 15.0, "dividends_paid": -5.0}
    assert run(spark, eq)["V09"][0] == "passed"
    eps = {"eps_basic": 2.0, "net_income": 20.0, "weighted_avg_shares": 10.0, "partners_capital": 5.0, "total_equity": 5.0}
    assert run(spark, eps)["V10"][0] == "passed" and run(spark, eps, "T2")["V10"][0] == "skipped"
    assert run(spark, eps)["V11"][0] == "skipped" and run(spark, eps, "T6")["V11"][0] == "passed"
    assert run(spark, {**eps, "weighted_avg_shares": 0.0})["V10"][0] == "skipped"


def test_confidence(spark):
    rows = spark.createDataFrame([(1, "total_assets", 0.99, False), (1, "cash_from_operations", 0.99, False), (1, "cash_start", 1.0, True), (1, None, 0.0, False)],
                                 "document_id int, canonical_field string, confidence double, ocr boolean")
    failed = spark.createDataFrame([(1, "failed", R.VALIDATION_CHECKS["V05"][1]), (1, "passed", R.VALIDATION_CHECKS["V01"][1])], "document_id int, status string, formula string")
    got = {r["canonical_field"]: (r["score"], r["review_status"]) for r in C.score_confidence(rows, failed).collect()}
    assert got["total_assets"] == (0.955, "auto_approved") and got["cash_from_operations"] == (0.955, "auto_approved")
    assert got["cash_start"] == (pytest.approx(0.5 + 0.18 + 0.06 + 0.08 - 0.05), "needs_review") and got[None][0] == pytest.approx(0.34)


def test_health(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "document_id int")
    ck = spark.createDataFrame([(1, "passed"), (1, "passed"), (1, "failed"), (1, "skipped"), (2, "skipped")], "document_id int, status string")
    got = {r["document_id"]: (r["api_health"], r["list_health"]) for r in K.health_score(docs, ck).collect()}
    assert got == {1: (67, 67), 2: (0, 100), 3: (100, 100)}


def test_primary_year_ties(spark):
    v = spark.createDataFrame([(1, "2023"), (1, "2022"), (1, "note"), (1, "2022"), (1, "2023")], "document_id int, year string")
    assert C.primary_year(v).first()["primary_year"] == "2023" and C.primary_year(v, "frequent").first()["primary_year"] == "2022"


def test_bulk_approve(spark):
    df = spark.createDataFrame([("needs_review", 0.95), ("needs_review", 0.5), ("override", 0.1)], "review_status string, score double")
    assert [r[0] for r in C.bulk_approve(df).orderBy(F.desc("score")).select("review_status").collect()] == ["auto_approved", "needs_review", "override"]
    assert C.bulk_approve(df, compat=True).filter("review_status = 'needs_review'").count() == 0


def test_candidates_without_a_shared_word(spark):
    from ledgerloom.operators import coa as A

    chart = [("BS-001", "Amortization", "Balance Sheet"), ("BS-002", "Cash at bank", "Balance Sheet"), ("BS-003", "Inventory", "Balance Sheet"), ("BS-004", "Other assets", "Balance Sheet"), ("PL-001", "Amortisation", "P&L")]
    coa = spark.createDataFrame(chart, "coa_id string, line_item_name string, statement string")
    rows = spark.createDataFrame([(1, i, t, "balance_sheet") for i, t in enumerate(["Amortisation", "Inventories", "Cash in bank"], 1)], "document_id long, extraction_id int, raw_label string, statement_type string")
    got = {}
    for r in A.candidates(rows, coa).orderBy("extraction_id", "cand_rank").collect():
        got.setdefault(r.extraction_id, []).append(r.coa_id)
    assert {k: v[0] for k, v in got.items()} == {1: "BS-001", 2: "BS-003", 3: "BS-002"} and all(len(v) == 3 for v in got.values())
