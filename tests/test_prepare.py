"""Rows and values from line items: results with null keys, and how much is written and exchanged for them."""

import datetime as dt
from collections import defaultdict

from ledgerloom.plans.adapters import ROW_COLS, tables


def write(spark, folder, lines=400):
    day = lambda i: None if i % 29 == 0 else dt.date(2020 + i % 3, 1, 1)
    make = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    part = [(p, None if p == 7 else f"part {p % 9}", ["ECONOMY", "LARGE", "PROMO", None][p % 4], None if p == 5 else p % 6) for p in range(20)]
    orders = [(o, None if o == 3 else o % 5) for o in range(30)]
    line = [(i % 30, i % 20, day(i), None if i % 31 == 0 else float(i % 17)) for i in range(lines)]
    make(part, "p_partkey int, p_name string, p_type string, p_size int", "part")
    make(orders, "o_orderkey int, o_custkey long", "orders")
    make(line, "l_orderkey int, l_partkey int, l_shipdate date, l_extendedprice double", "lineitem")
    return part, dict(orders), line


def expected(part, orders, line):
    kinds = {"ECONOMY": "balance_sheet", "LARGE": "income_statement", "PROMO": "cash_flow"}
    leaf = defaultdict(list)
    for o, p, d, v in line:
        _, name, kind, size = part[p]
        leaf[orders[o], kinds.get(kind, "equity_statement"), None if size is None else size % 5, name, None if d is None else str(d.year)].append(v)
    values = defaultdict(list)
    for (doc, st, no, name, year), vs in leaf.items():
        values[doc, st, no, name, False, year] += vs
        values[doc, st, no, None if no is None else f"Total section {no}", True, year] += vs
    total = lambda k, vs: (None if not (known := [v for v in vs if v is not None]) else sum(known) * (2 if k[4] and None not in k[:3:2] and (k[0] + k[2]) % 7 == 0 else 1))
    return {k: total(k, vs) for k, vs in values.items()}


def test_rows_and_values_with_null_keys_are_written_once(spark, tmp_path):
    want = expected(*write(spark, tmp_path))
    t = tables(spark, str(tmp_path))
    rows = [tuple(r) for r in t.rows.select("document_id", "statement_type", "section_no", "raw_label", "is_subtotal", "extraction_id").collect()]
    assert sorted(map(str, {k[:5] for k in want})) == sorted(str(r[:5]) for r in rows)
    low = lambda v: (v is not None, v)  # nulls first
    for doc in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == doc), key=lambda r: [low(x) for x in (r[1], r[2], r[4], r[3])])
        assert [r[5] for r in mine] == list(range(1, len(mine) + 1))
    got = {tuple(r[c] for c in ("document_id", "statement_type", "section_no", "raw_label", "is_subtotal", "year")): r["value"] for r in t.row_values.collect()}
    assert got == {k: v for k, v in want.items() if None not in k[:5]}
    assert t.row_values.columns == [*ROW_COLS, "year", "value", "extraction_id"]
    assert set(t._stages) == {"rows"}, "line items are written once, not as values, rows and rows with values"



def test_joins_of_stored_rows_need_no_exchange(spark, tmp_path, capsys):
    write(spark, tmp_path)
    t = tables(spark, str(tmp_path))
    keys = ["document_id", "extraction_id"]
    t.rows.join(t.row_values.select(*keys, "year"), keys).groupBy("document_id", "statement_type", "year").count().explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "Exchange hashpartitioning" not in plan
