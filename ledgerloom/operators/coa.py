"""Spreading rows to the chart of accounts: gating, candidates, routing, signs, aggregation, balance.

Keys: rows (document_id, extraction_id); values in long form with year and value; chart by coa_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from ..session import materialise
from .ordered import part_no, top_k
from .similar import similar_lines, words_of

BALANCE_TOLERANCE = 0.001
ROWS_PER_PART = 10_000
#: Lines of a chart in one value.
CHART_LINES = 1000


def gate_rows(rows: DataFrame) -> DataFrame:
    """Adds coa_statement and gate: 'map', 'not_spread' (equity, with a fixed note) or 'skipped'."""
    statement = X._chain([(F.col("statement_type") == k, v) for k, v in R.COA_STATEMENT.items()])
    equity = F.col("statement_type") == "equity_statement"
    return rows.withColumns({"coa_statement": statement,
                             "gate": F.when(statement.isNotNull(), "map").when(equity, "not_spread").otherwise("skipped"),
                             "gate_note": F.when(equity, R.EQUITY_NOTE)})


def candidates(rows: DataFrame, coa: DataFrame, k: int = 3) -> DataFrame:
    """Top k chart lines of each row within its statement, by shared words and edit distance.

    Scored once per distinct label (`similar.similar_lines`).
    """
    gated = gate_rows(rows).filter("gate = 'map'").withColumn("label_key", X.label_key("raw_label"))
    labels = gated.select("coa_statement", F.col("label_key").alias("label")).distinct()
    text = F.concat_ws(" ", "line_item_name", *(["definition"] if "definition" in coa.columns else []))
    chart = coa.select(F.col("coa_id").alias("line_id"), F.col("statement").alias("coa_statement"), X.label_key("line_item_name").alias("name"), words_of(X.label_key(text)).alias("words"))
    best = similar_lines(labels, chart, ["coa_statement"], k)
    return gated.select("document_id", "extraction_id", "coa_statement", "label_key").join(
        best.select("coa_statement", F.col("label").alias("label_key"), "cand_rank", F.col("line_id").alias("coa_id"), "score"), ["coa_statement", "label_key"])


def validate_suggestions(rows: DataFrame, answers: DataFrame, suggestions: DataFrame, coa: DataFrame,
                         single: DataFrame | None = None) -> DataFrame:
    """Answers checked against the chart of the row's statement.

    'UNMAPPED' or an empty id means none; an id outside the gated chart falls back to the row's first valid
    candidate, else to none with confidence 0. Rows without a usable batch answer take the single-row answer,
    whose invalid id without a valid candidate is a failure. Confidence must lie in 0..1.
    """
    gated = gate_rows(rows).filter("gate = 'map'").select("document_id", "extraction_id", "coa_statement")
    valid = coa.select("coa_id", F.col("statement").alias("coa_statement"))
    first = (suggestions.join(gated, ["document_id", "extraction_id"]).join(valid, ["coa_id", "coa_statement"])
             .groupBy("document_id", "extraction_id").agg(F.min_by("coa_id", "cand_rank").alias("first_valid")))

    def usable(a: DataFrame, tag: str) -> DataFrame:
        return a.filter(F.col("confidence").between(0, 1)).select("document_id", "extraction_id", F.lit(True).alias(f"_has_{tag}"),
                                                                  F.col("coa_id").alias(f"_id_{tag}"), F.col("confidence").alias(f"_conf_{tag}"))

    keys = ["document_id", "extraction_id"]
    j = gated.join(usable(answers, "b"), keys, "left").join(usable(answers.limit(0) if single is None else single, "s"), keys, "left")
    j = j.withColumns({"_batch": F.coalesce("_has_b", F.lit(False)),
                       "coa_id": F.when(F.col("_has_b"), F.col("_id_b")).otherwise(F.col("_id_s")),
                       "confidence": F.when(F.col("_has_b"), F.col("_conf_b")).otherwise(F.col("_conf_s")),
                       "_any": F.coalesce("_has_b", "_has_s", F.lit(False))})
    none = F.coalesce(F.col("coa_id").isin("UNMAPPED", ""), F.lit(True))
    ok = valid.select("coa_id", "coa_statement", F.lit(True).alias("_ok"))
    j = j.join(ok, ["coa_id", "coa_statement"], "left").join(first, keys, "left")
    chosen = F.when(none, None).when(F.col("_ok"), F.col("coa_id")).otherwise(F.col("first_valid"))
    failed = ~F.col("_any") | (~none & F.col("_ok").isNull() & F.col("first_valid").isNull() & ~F.col("_batch"))
    return j.select(*keys, "coa_statement", chosen.alias("coa_id"),
                    F.when(chosen.isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"),
                    F.when(failed, "mapping_failed").otherwise("ok").alias("answer_status"))


def route(rows: DataFrame, answers: DataFrame, learned: DataFrame | None = None, threshold: float = R.ROUTE_THRESHOLD) -> DataFrame:
    """Outcome of every row: mapped, unmapped (pending), not_spread or skipped.

    A learned mapping (document_id, extraction_id, coa_id, confidence, learned_id) goes before the answer.
    """
    keys = ["document_id", "extraction_id"]
    j = gate_rows(rows).join(answers.select(*keys, F.col("coa_id").alias("_a_id"), F.col("confidence").alias("_a_conf")), keys, "left")
    if learned is None:
        j = j.withColumns({"_l_id": F.lit(None).cast("string"), "_l_conf": F.lit(None).cast("double"), "learned_id": F.lit(None).cast("bigint")})
    else:
        j = j.join(learned.select(*keys, F.col("coa_id").alias("_l_id"), F.col("confidence").alias("_l_conf"), "learned_id"), keys, "left")
    by_learning = (F.col("gate") == "map") & F.col("_l_id").isNotNull()
    by_answer = (F.col("gate") == "map") & (F.coalesce("_a_id", F.lit("")) != "") & (F.col("_a_conf") >= threshold)
    mapped = by_learning | F.coalesce(by_answer, F.lit(False))
    return j.withColumns({
        "status": F.when(mapped, "mapped").when(F.col("gate") == "map", "unmapped").otherwise(F.col("gate")),
        "coa_id": F.when(by_learning, F.col("_l_id")).when(mapped, F.col("_a_id")),
        "confidence": F.when(by_learning, F.col("_l_conf")).when(mapped, F.col("_a_conf")),
        "mapping_source": F.when(by_learning, "learned").when(mapped, "model"),
        "learned_id": F.when(by_learning, F.col("learned_id"))}).drop("_a_id", "_a_conf", "_l_id", "_l_conf")


def queue_items(routed: DataFrame, suggestions: DataFrame, ambiguities: DataFrame | None = None) -> DataFrame:
    """Rows for review (unmapped, not_spread) with what their answer offered.

    suggestions: all of a pending row's candidates in order, as (coa_id, score, reason); ambiguity_note: its
    ambiguities (document_id, extraction_id, ambiguities) joined by '; ', and for rows that are not spread the fixed note.
    """
    keys = ["document_id", "extraction_id"]
    waits = F.col("status") == "unmapped"
    reason = (F.col("reason") if "reason" in suggestions.columns else F.lit(None).cast("string")).alias("reason")
    offered = suggestions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cand_rank", "coa_id", "score", reason))).alias("suggestions"))
    q = routed.filter(F.col("status").isin("unmapped", "not_spread")).join(offered, keys, "left")
    q = q if ambiguities is None else q.join(ambiguities.select(*keys, "ambiguities"), keys, "left")
    said = F.lit("") if ambiguities is None else F.coalesce(F.array_join("ambiguities", "; "), F.lit(""))
    none = F.array().cast(offered.schema["suggestions"].dataType)
    q = q.withColumns({"suggestions": F.when(waits, F.coalesce("suggestions", none)).otherwise(none), "ambiguity_note": F.when(waits, said).otherwise(F.col("gate_note"))})
    return q.select(*routed.columns, "suggestions", "ambiguity_note")


def apply_sign(mapped_values: DataFrame, coa: DataFrame) -> DataFrame:
    """Contra and negative lines become −|value|; `changed` tells whether this value changed."""
    signs = coa.select("coa_id", "sign_convention")
    j = mapped_values.join(signs, "coa_id", "left").withColumn("_v", X.signed("value", "sign_convention"))
    return j.withColumn("changed", F.coalesce(F.col("_v") != F.col("value"), F.lit(False))).withColumn("value", F.col("_v")).drop("_v", "sign_convention")


def signed_values(routed: DataFrame, row_values: DataFrame, coa: DataFrame) -> DataFrame:
    """Signed values of the mapped rows, one row per (row, year)."""
    m = routed.filter("status = 'mapped'").select("document_id", "extraction_id", "coa_id")
    return apply_sign(row_values.join(m, ["document_id", "extraction_id"]), coa)


def aggregate_mappings(signed: DataFrame) -> DataFrame:
    """Value per (document, chart line, year): nulls are skipped, all nulls stay null."""
    return signed.groupBy("document_id", "coa_id", "year").agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_values"), F.max("changed").alias("sign_applied"))


def mapping_heads(routed: DataFrame) -> DataFrame:
    """One row per (document, chart line): the first source row's attributes and the number of source rows."""
    m = routed.filter("status = 'mapped'")
    first = F.struct("raw_label", "statement_type", "confidence", "mapping_source")
    out = m.groupBy("document_id", "coa_id").agg(F.count(F.lit(1)).alias("aggregated_from"), F.min("extraction_id").alias("first_row"),
                                                 F.min_by(first, "extraction_id").alias("f"))
    note = F.when(F.col("aggregated_from") > 1, F.concat(F.lit("[Aggregated from "), F.col("aggregated_from").cast("string"), F.lit(" source rows.]"))).otherwise("")
    return out.select("document_id", "coa_id", "aggregated_from", "first_row", "f.*").withColumn("rationale_note", note)


def mapping_sources(routed: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Source rows of each chart line in order: labels joined by ' + ' and row ids, in parts of bounded size."""
    m = routed.filter("status = 'mapped'")
    lst = F.array_sort(F.collect_list(F.struct("extraction_id", "raw_label")))
    out = m.groupBy("document_id", "coa_id", part_no("extraction_id", rows_per_part).alias("part_no")).agg(lst.alias("s"))
    return out.select("document_id", "coa_id", "part_no", F.array_join(F.col("s.raw_label"), " + ").alias("labels"),
                      F.col("s.extraction_id").alias("source_extraction_ids"))


def outcomes(routed: DataFrame) -> DataFrame:
    """Outcome per (trimmed lower label, statement) of a document; the last row wins."""
    cols = F.struct("status", "coa_id", "confidence", "mapping_source", "extraction_id")
    spread = routed.filter("status <> 'skipped'")
    return spread.groupBy("document_id", F.lower(F.trim("raw_label")).alias("label"), "statement_type").agg(
        F.max_by(cols, "extraction_id").alias("o")).select("document_id", "label", "statement_type", "o.*").withColumn(
        "status", F.when(F.col("status") == "mapped", "mapped").otherwise("unmapped"))


def row_outcomes(rows: DataFrame, routed: DataFrame) -> DataFrame:
    """Rows with the mapping they ended in; rows without an outcome are not_spread."""
    o = routed.filter("status <> 'skipped'").select("document_id", "extraction_id", F.col("status").alias("_s"), "coa_id", "confidence")
    return rows.join(o, ["document_id", "extraction_id"], "left").withColumn("mapping_status", F.coalesce("_s", F.lit("not_spread"))).drop("_s")


def spread_summary(routed: DataFrame) -> DataFrame:
    """Counts per document and whether anything is still pending."""
    n = lambda cond: F.count_if(F.expr(cond))
    return routed.groupBy("document_id").agg(
        n("status = 'mapped' AND mapping_source = 'learned'").alias("learned"), n("status = 'mapped' AND mapping_source = 'model'").alias("model"),
        n("status = 'unmapped'").alias("unmapped"), n("status = 'skipped'").alias("skipped"), n("status = 'not_spread'").alias("equity")).withColumn(
        "spread_status", F.when(F.col("unmapped") > 0, "has_unmapped").otherwise("spread_complete"))


def _category(name: str) -> dict[str, list[str]]:
    return {"assets": ["Current Assets", "Non-Current Assets"], "liabilities": ["Current Liabilities", "Non-Current Liabilities"],
            "equity": ["Equity"]}[name]


def balance_identity(values: DataFrame, coa: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A = L + E per document and year over the leaf lines of the balance sheet.

    `values` may be signed row values or aggregated ones: only sums are taken, in one exchange of partial
    sums. `headline` marks the latest year. Documents without balance-sheet values are absent.
    """
    by = by or ["document_id"]
    chart = coa.filter("statement = 'Balance Sheet'").select("coa_id", "broad_category", (~F.coalesce("is_subtotal", F.lit(False))).alias("_leaf"))
    j = values.select(*by, "coa_id", "year", "value").join(chart, "coa_id")
    leaf = F.col("_leaf")

    def part(name: str):
        return F.coalesce(F.sum(F.when(leaf & F.col("broad_category").isin(_category(name)), F.col("value"))), F.lit(0.0)).alias(f"total_{name}")

    t = j.groupBy(*by, "year").agg(part("assets"), part("liabilities"), part("equity"))
    le = F.col("total_liabilities") + F.col("total_equity")
    # Sums of cents: rounding to cents removes the order of addition from the comparison with zero.
    t = t.withColumn("difference", F.round(F.col("total_assets") - le, 2) + 0.0)
    ok = F.when(F.col("total_assets") != 0, F.abs("difference") / F.abs("total_assets") < BALANCE_TOLERANCE).otherwise(F.abs("difference") < 1e-9)
    latest = F.max("year").over(Window.partitionBy(*by))  # a handful of years per document
    return t.withColumns({"is_balanced": ok, "headline": F.col("year") == latest})


def imbalance_contributors(aggregated: DataFrame, coa: DataFrame, balance: DataFrame, k: int = 5) -> DataFrame:
    """Largest balance-sheet leaves of unbalanced documents in the headline year."""
    off = balance.filter("headline AND NOT is_balanced").select("document_id", "year")
    chart = coa.filter("statement = 'Balance Sheet' AND NOT coalesce(is_subtotal, false)").select("coa_id", "line_item_name")
    v = aggregated.filter("value IS NOT NULL").join(off, ["document_id", "year"], "left_semi").join(chart, "coa_id")
    return top_k(v, ["document_id"], [F.desc(F.abs("value")), F.col("coa_id")], k)


def category_subtotals(values: DataFrame, coa: DataFrame, rollup: bool = False) -> DataFrame:
    """Leaf totals per statement and category in the document's latest mapped year; with rollup also above."""
    last = values.groupBy("document_id").agg(F.max("year").alias("year"))
    chart = coa.filter("NOT coalesce(is_subtotal, false)").select("coa_id", "statement", "broad_category")
    v = values.join(last, ["document_id", "year"], "left_semi").filter("value IS NOT NULL").join(chart, "coa_id")
    if rollup:
        return v.rollup("statement", "broad_category").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_values"))
    return v.groupBy("document_id", "statement", "broad_category", "year").agg(F.sum("value").alias("total"))


def format_spread(documents: DataFrame, aggregated: DataFrame, heads: DataFrame, coa: DataFrame, lines_per_part: int = CHART_LINES) -> DataFrame:
    """The whole chart for every document, blanks where nothing is mapped, one row per line and year.

    The chart lies in numbered parts of `lines_per_part` lines; every document meets each part by an equi-join on its
    number, so that no value holds a whole chart.
    """
    order = [F.split_part("coa_id", F.lit("-"), F.lit(1)), F.split_part("coa_id", F.lit("-"), F.lit(2)).cast("int"), F.col("coa_id")]
    chart = coa.select("coa_id", "line_item_name", "statement")
    # A chart of accounts is numbered once, whatever the number of documents.
    chart = chart.withColumn("line_no", F.row_number().over(Window.orderBy(*order, "line_item_name", "statement")))
    chart = chart.withColumn("_part", F.floor((F.col("line_no") - 1) / lines_per_part).cast("int"))
    parts = materialise(chart.groupBy("_part").agg(F.array_sort(F.collect_list(F.struct("line_no", "coa_id", "line_item_name", "statement"))).alias("_lines")))
    last = parts.agg(F.max("_part")).first()[0]
    wanted = documents.select("document_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(last)) if last is not None else F.array().cast("array<int>")))
    lines = wanted.join(parts, "_part").select("document_id", F.inline("_lines"))
    h = heads.select("document_id", "coa_id", "confidence", "mapping_source")
    v = aggregated.select("document_id", "coa_id", "year", "value")
    return lines.join(h, ["document_id", "coa_id"], "left").join(v, ["document_id", "coa_id"], "left")
