import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import analytics as N
from ledgerloom.operators import coa as A
from ledgerloom.operators import learning as L
from ledgerloom.operators import reconcile as Q
from ledgerloom.operators import state as S

COA = [("BS-001", "Cash", "Balance Sheet", "Current Assets", "positive", False), ("BS-002", "Loans", "Balance Sheet", "Non-Current Liabilities", "positive", False),
       ("BS-003", "Capital", "Balance Sheet", "Equity", "positive", False), ("BS-004", "Total Assets", "Balance Sheet", "Current Assets", "positive", True),
       ("BS-005", "Accumulated depreciation", "Balance Sheet", "Non-Current Assets", "contra", False), ("PL-001", "Sales", "P&L", "Revenue", "positive", False)]


@pytest.fixture(scope="module")
def coa(spark):
    return spark.createDataFrame(COA, "coa_id string, line_item_name string, statement string, broad_category string, sign_convention string, is_subtotal boolean")


def vals(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "document_id long, coa_id string, year string, value double")


def test_balance(spark, coa):
    v = vals(spark, [("BS-001", "2023", 100.0), ("BS-002", "2023", 60.0), ("BS-003", "2023", 40.0), ("BS-004", "2023", 100.0), ("BS-001", "2022", 100.0), ("BS-003", "2022", 99.0),
                     ("PL-001", "2024", 5.0)])
    got = {r["year"]: (r["is_balanced"], r["difference"], r["headline"]) for r in A.balance_identity(v, coa).collect()}
    assert got == {"2023": (True, 0.0, True), "2022": (False, 1.0, False)}
    edge = A.balance_identity(vals(spark, [("BS-001", "2023", 1000.0), ("BS-003", "2023", 999.0)]), coa).first()
    assert edge["is_balanced"] is False  # 0.1 % is not below 0.1 %
    zero = A.balance_identity(vals(spark, [("BS-002", "2023", 0.0)]), coa).first()
    assert zero["is_balanced"] is True and A.balance_identity(vals(spark, [("PL-001", "2023", 1.0)]), coa).count() == 0


def test_sign_and_nulls(spark, coa):
    v = A.apply_sign(vals(spark, [("BS-005", "2023", 5.0), ("BS-005", "2022", -5.0), ("BS-005", "2021", None), ("BS-001", "2023", -3.0)]), coa)
    got = {(r["coa_id"], r["year"]): (r["value"], r["changed"]) for r in v.collect()}
    assert got == {("BS-005", "2023"): (-5.0, True), ("BS-005", "2022"): (-5.0, False), ("BS-005", "2021"): (None, False), ("BS-001", "2023"): (-3.0, False)}
    agg = A.aggregate_mappings(spark.createDataFrame([(1, "c", "2023", None, False), (1, "c", "2023", 4.0, False), (1, "c", "2022", None, False)],
                                                     "document_id long, coa_id string, year string, value double, changed boolean"))
    assert {r["year"]: r["value"] for r in agg.collect()} == {"2023": 4.0, "2022": None}


def test_route(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["balance_sheet"] * 4 + ["equity_statement", "cash_flow"], 1)], "document_id long, extraction_id int, statement_type string")
    ans = spark.createDataFrame([(1, 1, "BS-001", 0.55), (1, 2, "BS-001", 0.549), (1, 3, "", 0.9), (1, 5, "BS-001", 0.9)], "document_id long, extraction_id int, coa_id string, confidence double")
    learned = spark.createDataFrame([(1, 4, "BS-009", 0.95, 7)], "document_id long, extraction_id int, coa_id string, confidence double, learned_id long")
    got = {r["extraction_id"]: (r["status"], r["coa_id"], r["mapping_source"]) for r in A.route(rows, ans, learned).collect()}
    assert got == {1: ("mapped", "BS-001", "model"), 2: ("unmapped", None, None), 3: ("unmapped", None, None), 4: ("mapped", "BS-009", "learned"),
                   5: ("not_spread", None, None), 6: ("skipped", None, None)}


def test_learned_tiers_and_feedback(spark):
    lm = spark.createDataFrame([(1, "trade debtors", "T1", "A", 0, 0, 1), (2, "trade debtors", "*", "B", 0, 0, 5), (3, "trade debtors", "T1", "C", 4, 0, 3), (4, "trade debtors", "T1", "D", 0, 2, 9),
                                (5, "net trade debtors x", "T9", "E", 0, 0, 2)],
                               "learned_id long, label_key string, template_type string, coa_id string, times_applied int, times_overridden int, created_seq long")
    lm = lm.withColumns({"learned_confidence": F.lit(0.95), "statement_type": F.lit("balance_sheet")})
    rows = spark.createDataFrame([(1, 1, "Trade Debtors", "T1"), (1, 2, "TRADE debtors!", "T1"), (1, 3, "trade debtors", "T2"), (1, 4, "debtors x", "T1"), (1, 5, "???", "T1")],
                                 "document_id long, extraction_id int, raw_label string, template_type string").withColumn("statement_type", F.lit("balance_sheet"))
    hits = L.learned_lookup(rows, lm)
    assert {r["extraction_id"]: (r["tier"], r["coa_id"]) for r in hits.collect()} == {1: (1, "C"), 2: (1, "C"), 3: (2, "B"), 4: (3, "E")}
    seen, after = L.apply_learning_feedback(hits, lm)
    assert {r["extraction_id"]: (r["times_seen"], r["confidence_seen"]) for r in seen.collect()} == {1: (4, 0.95), 2: (5, 0.99), 3: (0, 0.95), 4: (0, 0.95)}
    assert {r["learned_id"]: (r["times_applied"], r["learned_confidence"]) for r in after.filter("learned_id IN (2, 3)").collect()} == {2: (1, 0.95), 3: (6, 0.99)}


def footing(total, extracted):
    return extracted is not None and total is not None and (abs(total - extracted) <= 1.0 or extracted != 0 and abs(total - extracted) < 0.001 * abs(extracted))


def check_grouping(rows, found):
    """What holds for the grouping of a statement, whichever way it is found. `found`: subtotal -> (method, components)."""
    taken = [c for _, comp in found.values() for c in comp]
    assert len(taken) == len(set(taken)), "a row is in two subtotals"
    assert set(found) == {i for i, r in enumerate(rows, 1) if r["sub"]}
    for sid, (method, comp) in found.items():
        own = rows[sid - 1]
        year = max(own["values"], default=None)
        amounts = [rows[c - 1]["values"].get(year) for c in comp]
        sums = lambda n, a=amounts: None if n == 0 or None in a[-n:] else sum(a[-n:])
        foots = footing(sums(len(amounts)), own["values"].get(year))
        shallower = [i for i, r in enumerate(rows[: sid - 1], 1) if r["sub"] and r["level"] < own["level"]]
        same = [i for i, r in enumerate(rows[: sid - 1], 1) if r["sub"] and r["level"] <= own["level"]]
        assert all(c < sid for c in comp) and (not comp or min(comp) > max(shallower, default=0)), "a shallower subtotal is crossed"
        near = [c for c in comp if c > max(same, default=0)]
        assert (foots or year is None) == (method != "unresolved")
        if method == "absorbed":
            assert len(near) < len(comp) and rows[max(same) - 1]["level"] == own["level"]
            assert not any(footing(sums(n), own["values"].get(year)) for n in range(len(near), len(comp))), "fewer rows foot as well"
        else:
            assert near == list(comp), "a row behind an equal subtotal is taken"


HAND_WORKED = {
    # Two totals of one level: the second takes the first up, as only with it do 100 - 30 make 70.
    60: ([(0, 1, 100.0), (1, 0, 100.0), (0, 1, -30.0), (1, 0, 70.0)], {2: ("leaves", (1,)), 4: ("absorbed", (2, 3))}),
    # Parts below a total, and what belongs to no total.
    61: ([(0, 2, 1.0), (1, 1, 1.0), (0, 2, 2.0), (0, 2, 3.0), (1, 1, 5.0), (1, 0, 6.0), (0, 2, 9.0)], {2: ("leaves", (1,)), 5: ("leaves", (3, 4)), 6: ("leaves", (2, 5))}),
    # Does not foot, whatever it takes up.
    62: ([(0, 1, 10.0), (1, 1, 10.0), (0, 1, 20.0), (1, 1, 77.0)], {2: ("leaves", (1,)), 4: ("unresolved", (3,))}),
    # Deep levels stay apart: 12 below 11 below 10.
    63: ([(0, 13, 4.0), (1, 12, 4.0), (0, 13, 6.0), (1, 12, 6.0), (1, 11, 10.0), (1, 10, 10.0)], {2: ("leaves", (1,)), 4: ("leaves", (3,)), 5: ("leaves", (2, 4)), 6: ("leaves", (5,))}),
    # The absorbed run ends before a shallower total.
    64: ([(0, 2, 5.0), (1, 0, 5.0), (0, 2, 3.0), (1, 1, 3.0), (0, 2, 4.0), (1, 1, 12.0)], {2: ("leaves", (1,)), 4: ("leaves", (3,)), 6: ("unresolved", (5,))}),
}


def random_statement(rnd, n):
    rows = []
    for _ in range(n):
        sub = rnd.random() < 0.4
        row = {"sub": sub, "level": rnd.randrange(3) if sub else rnd.randrange(3), "values": {"2023": float(rnd.choice([10, 20, 30]))}}
        if rnd.random() < 0.1:
            row["values"]["2023"] = None
        if rnd.random() < 0.1:
            row["values"] = {"2022": 5.0}
        if sub and rows and rnd.random() < 0.8:  # make it foot some run of the rows before it
            k = rnd.randrange(1, min(len(rows), 5) + 1)
            row["values"] = {"2023": sum(r["values"].get("2023") or 0.0 for r in rows[-k:]) or 1.0}
        rows.append(row)
    return rows


def test_group_subtotals(spark):
    rnd = random.Random(11)
    docs = {d: random_statement(rnd, rnd.randrange(3, 30)) for d in range(60)}
    docs |= {d: [{"sub": bool(sub), "level": level, "values": {"2023": v}} for sub, level, v in rows] for d, (rows, _) in HAND_WORKED.items()}
    rows = [(d, "balance_sheet", i, f"r{i}", r["sub"], r["level"]) for d, rs in docs.items() for i, r in enumerate(rs, 1)]
    values = [(d, i, y, v) for d, rs in docs.items() for i, r in enumerate(rs, 1) for y, v in r["values"].items()]
    rdf = spark.createDataFrame(rows, "document_id long, statement_type string, extraction_id int, raw_label string, is_subtotal boolean, indentation_level int")
    vdf = spark.createDataFrame(values, "document_id long, extraction_id int, year string, value double")
    comps, subs = Q.group_subtotals(rdf, vdf)
    parts = {}
    for r in comps.collect():
        parts.setdefault((r["document_id"], r["subtotal_id"]), []).append(r["component_id"])
    found = {d: {} for d in docs}
    for r in subs.collect():
        found[r["document_id"]][r["subtotal_id"]] = (r["method"], tuple(sorted(parts.get((r["document_id"], r["subtotal_id"]), []))))
    for d, statement in docs.items():
        check_grouping(statement, found[d])
    assert {d: found[d] for d in HAND_WORKED} == {d: want for d, (_, want) in HAND_WORKED.items()}
    assert {m for f in found.values() for m, _ in f.values()} == {"leaves", "absorbed", "unresolved"}
    outcomes = spark.createDataFrame([], "document_id long, label string, statement_type string, status string")
    years, report = Q.crossfoot(comps, subs, rdf, vdf, outcomes)
    y = years.filter("document_id = 60 AND subtotal_id = 4").first()
    assert (y["computed"], y["difference"], y["passed"]) == (70.0, 0.0, True)
    assert report.filter("document_id = 60 AND subtotal_id = 4").first()["has_unmapped"] is True


def test_given_groups_consume(spark):
    # Flat: 1 leaf, 2 leaf, 3 total that takes row 1 only, 4 leaf, 5 total of rows 2 and 4, 6 total that takes 3 and 5.
    values = {1: 10.0, 2: 5.0, 3: 10.0, 4: 7.0, 5: 12.0, 6: 22.0, 7: 9.0, 8: 31.0}
    rows = [(1, "balance_sheet", i, f"r{i}", i in (3, 5, 6, 8), 0) for i in values] + [(2, "balance_sheet", i, f"r{i}", i in (3, 5, 6, 8), i % 2) for i in values]
    rdf = spark.createDataFrame(rows, "document_id long, statement_type string, extraction_id int, raw_label string, is_subtotal boolean, indentation_level int")
    vdf = spark.createDataFrame([(d, i, "2023", v) for d in (1, 2) for i, v in values.items()], "document_id long, extraction_id int, year string, value double")
    groups = spark.createDataFrame([(d, "balance_sheet", s, c) for d in (1, 2) for s, c in [(3, 1), (6, 3), (6, 5), (6, 8)]], "document_id long, statement_type string, subtotal_id int, component_id int")
    comps, subs = Q.group_subtotals(rdf, vdf, groups)
    parts = {}
    for r in comps.filter("document_id = 1").collect():
        parts.setdefault(r.subtotal_id, []).append(r.component_id)
    got = {r.subtotal_id: (r.method, r.grouping_confidence, sorted(parts.get(r.subtotal_id, []))) for r in subs.filter("document_id = 1").collect()}
    # 5 takes leaf 4; with the free total 3 that makes 17, with leaf 2 as well 22: neither is 12.
    assert got[3] == ("given", "given", [1]) and got[6] == ("given", "given", [3, 5])
    assert got[5] == ("unresolved", "given", [4])
    # 8 takes leaf 7 and, to foot, the free total 6: what 6 has taken (3 and 5) is gone.
    assert got[8] == ("absorbed", "given", [6, 7])
    assert {r.grouping_confidence for r in subs.filter("document_id = 2").collect()} == {"high"} and subs.filter("document_id = 2 AND method = 'given'").count() == 0


def test_sign_flip(spark):
    raw = spark.createDataFrame([(1, 1, "2023", 5.0), (1, 2, "2023", -5.0), (1, 3, "2023", 0.0)], "document_id long, extraction_id int, year string, value double")
    mapped = raw.withColumn("value", -F.abs("value"))
    assert {r["extraction_id"]: r["sign_flipped"] for r in Q.sign_flip(raw, mapped).collect()} == {1: True, 2: False, 3: False}


def test_threshold_sweep_invariants(spark):
    from ledgerloom.plans import queries_coa as QC
    from ledgerloom.plans import queries_views as QV
    from ledgerloom.plans.adapters import tables

    t = tables(spark, "/root/testdata/sf0.001")
    sweep = N.threshold_coverage(QC.routed(t), QV.pending(t))
    bad = sweep.groupBy("document_id").agg(F.countDistinct(F.col("mapped") + F.col("still_unmapped")).alias("totals"),
                                           F.max(F.when(F.col("threshold") == 0.6, F.col("mapped"))).alias("hi"), F.max(F.when(F.col("threshold") == 0.0, F.col("mapped"))).alias("lo"))
    assert bad.filter("totals <> 1 OR hi > lo").count() == 0


def test_upsert_and_skip(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(tuple(r) for r in S.upsert(a, b, ["k"]).collect()) == [(1, "x"), (2, "z"), (3, "w")]
