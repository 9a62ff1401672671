"""Registered queries on table changes and streams."""

from __future__ import annotations

import os
import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import coa as A
from ..operators import reconcile as Q
from ..operators import state as S
from ..session import materialise, work_dir
from ..sources import intake, readers
from ..sources.buckets import BucketTable
from ..streaming import decisions as D
from ..streaming import stages as G
from ..streaming import streams as T
from .catalog import query
from .queries_canonical import CAN, SC, scored
from .queries_coa import AG, BALANCE, COA, CROSSFOOT, LE, LH, RT, SG, aggregated, grouped, recon_rows, routed, signed
from .queries_views import PE, SUG, pending
from .queries_pages import PAGES, SEC, SCOPE

DEC = (*COA, "fx_decisions")


@query("a05_upsert", """SELECT coa_id, line_item_name, broad_category FROM fx_coa WHERE statement = 'P&L'
UNION ALL SELECT coa_id, upper(line_item_name), 'New' FROM fx_coa WHERE statement <> 'P&L' UNION ALL SELECT concat('N', coa_id), line_item_name, 'Added' FROM fx_coa""", ("fx_coa",))
def a05(t):
    c = t.coa.select("coa_id", "line_item_name", "broad_category", "statement")
    changed = c.filter("statement <> 'P&L'").withColumns({"line_item_name": F.upper("line_item_name"), "broad_category": F.lit("New")})
    added = c.withColumns({"coa_id": F.concat(F.lit("N"), F.col("coa_id")), "broad_category": F.lit("Added")})
    return S.upsert(c, changed.unionByName(added), ["coa_id"]).select("coa_id", "line_item_name", "broad_category")


@query("a05_merge_columns", "SELECT document_id, company, CASE WHEN document_id % 2 = 0 THEN 'T9' ELSE template_type END AS template_type FROM fx_documents", ("fx_documents",))
def a05b(t):
    src = t.documents.select("document_id", F.when(F.col("document_id") % 2 == 0, "T9").alias("template_type"))
    return S.merge_columns(t.documents, src, ["document_id"]).select("document_id", "company", "template_type")


@query("a06_append", "SELECT statement_type, status AS mapping_status, count(*) AS n FROM (SELECT statement_type, CASE WHEN status = 'skipped' THEN 'not_spread' ELSE status END AS status FROM routed) r GROUP BY ALL", COA, RT)
def a06(t):
    """Rows with their outcomes appended to a table, statement by statement, then read."""
    done = A.row_outcomes(t.rows, routed(t))
    path = os.path.join(work_dir(t.spark), "append-" + uuid.uuid4().hex)
    S.append(done.filter("statement_type IN ('balance_sheet', 'income_statement')"), path, ("statement_type",))
    S.append(done.filter("statement_type NOT IN ('balance_sheet', 'income_statement')"), path, ("statement_type",))
    S.append(done.filter("false"), path, ("statement_type",))
    return t.spark.read.parquet(path).groupBy("statement_type", "mapping_status").agg(F.count(F.lit(1)).alias("n"))


@query("a07_delete_documents", "SELECT document_id, count(*) AS n FROM fx_rows WHERE document_id NOT IN (SELECT document_id FROM fx_documents WHERE template_type = 'T2') GROUP BY 1", ("fx_rows", "fx_documents"))
def a07(t):
    gone = t.documents.filter("template_type = 'T2'")
    kept, _ = S.delete_documents({"rows": t.rows}, gone, t.learned.withColumn("source_document_id", F.col("learned_id")))
    return kept["rows"].groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("a07_learned_kept", "SELECT learned_id, CASE WHEN learned_id NOT IN (SELECT document_id FROM fx_documents WHERE template_type = 'T2') THEN learned_id END AS source_document_id FROM fx_learned", ("fx_learned", "fx_documents"))
def a07b(t):
    gone = t.documents.filter("template_type = 'T2'")
    return S.delete_documents({}, gone, t.learned.withColumn("source_document_id", F.col("learned_id")))[1].select("learned_id", "source_document_id")


@query("a11_ingest", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a11(t):
    return readers.ingest(t.raw("documents"), t.raw("labels"), "doc_id").select("doc_id", "source")


RESOLVED = """SELECT r.*, d.coa_id AS new_coa_id, d.decision_id FROM routed r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, extraction_id
  ORDER BY decided_at DESC, decision_id DESC) AS rn FROM fx_decisions WHERE action = 'resolve') x WHERE rn = 1) d USING (document_id, extraction_id) WHERE r.status = 'unmapped'"""
RES = {**RT, "res": RESOLVED}


def resolved(t):
    return S.resolve_items(routed(t), t.row_values, t.decisions, t.documents)


@query("e23_resolve_rows", """SELECT r.document_id, r.extraction_id, CASE WHEN n.document_id IS NULL THEN r.status ELSE 'mapped' END AS status, coalesce(n.new_coa_id, r.coa_id) AS coa_id,
  CAST(CASE WHEN n.document_id IS NULL THEN r.confidence ELSE 0.95 END AS DOUBLE) AS confidence FROM routed r LEFT JOIN res n USING (document_id, extraction_id)""", DEC, RES)
def e23(t):
    return resolved(t)["rows"].select("document_id", "extraction_id", "status", "coa_id", "confidence")


@query("e23_resolve_values", "SELECT v.document_id, v.extraction_id, n.new_coa_id AS coa_id, v.year, v.value FROM res n JOIN fx_row_values v USING (document_id, extraction_id)", DEC, RES)
def e23b(t):
    return resolved(t)["values"].select("document_id", "extraction_id", "coa_id", "year", "value")


@query("e23_resolve_learned", """SELECT n.decision_id, lower(raw_label) AS label_key, statement_type, new_coa_id AS coa_id, d.template_type, d.filename AS source_document FROM res n LEFT JOIN fx_documents d USING (document_id)""",
       (*DEC, "fx_documents"), {**RES})
def e23c(t):
    return resolved(t)["learned"].select("decision_id", "label_key", "statement_type", "coa_id", "template_type", "source_document")


@query("e23_resolve_documents", """SELECT document_id, count(*) FILTER (status = 'unmapped') - count(n.decision_id) AS unmapped_count,
  CASE WHEN count(*) FILTER (status = 'unmapped') - count(n.decision_id) = 0 THEN 'spread_complete' ELSE 'has_unmapped' END AS spread_status
FROM routed r LEFT JOIN (SELECT document_id, extraction_id, decision_id FROM res) n USING (document_id, extraction_id) GROUP BY document_id""", DEC, RES)
def e23d(t):
    return resolved(t)["documents"]


@query("e23_resolve_errors", """SELECT document_id, extraction_id, max(decision_id) FILTER (rn = 1) AS decision_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, extraction_id
  ORDER BY decided_at DESC, decision_id DESC) AS rn FROM fx_decisions WHERE action = 'resolve') d WHERE (document_id, extraction_id) NOT IN (SELECT (document_id, extraction_id) FROM routed WHERE status = 'unmapped') GROUP BY ALL""", DEC, RT)
def e23e(t):
    return resolved(t)["errors"].select("document_id", "extraction_id", "decision_id")


OVER = """SELECT r.*, d.coa_id AS new_coa_id, d.decision_id, l.learned_id FROM routed r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, extraction_id
  ORDER BY decided_at DESC, decision_id DESC) AS rn FROM fx_decisions WHERE action = 'override') x WHERE rn = 1) d USING (document_id, extraction_id)
LEFT JOIN (SELECT document_id, extraction_id, learned_id FROM lhits) l USING (document_id, extraction_id)
WHERE r.statement_type IN ('balance_sheet', 'income_statement') AND (l.learned_id IS NOT NULL OR r.status = 'mapped')"""
OV, OVC = {**RT, **LH, "ov": OVER}, (*DEC, *LE)


def overridden(t):
    from .queries_views import learned_routed
    return S.override_mappings(learned_routed(t), t.learned, t.decisions, t.documents)


@query("e24_override_rows", "SELECT document_id, extraction_id, new_coa_id AS coa_id, CAST(0.95 AS DOUBLE) AS confidence FROM ov", OVC, OV)
def e24(t):
    return overridden(t)["rows"].filter("mapping_source = 'manual'").select("document_id", "extraction_id", "coa_id", "confidence")


@query("e24_override_learned", """SELECT learned_id, CAST(times_overridden + coalesce(n, 0) AS BIGINT) AS times_overridden,
  CAST(CASE WHEN n IS NOT NULL AND times_overridden + n >= 2 THEN 0.70 ELSE learned_confidence END AS DOUBLE) AS learned_confidence
FROM fx_learned LEFT JOIN (SELECT learned_id, count(*) AS n FROM ov WHERE learned_id IS NOT NULL GROUP BY 1) o USING (learned_id)""", OVC, OV)
def e24b(t):
    return overridden(t)["learned"].select("learned_id", "times_overridden", "learned_confidence")


@query("e25_refresh_checks", """SELECT s.document_id, s.year, round(coalesce(sum(v) FILTER (NOT c.is_subtotal AND c.broad_category IN ('Current Assets', 'Non-Current Assets')), 0), 2) AS total_assets
FROM (SELECT m.document_id, v.year, m.coa_id, CASE WHEN k.sign_convention = 'contra' THEN -abs(v.value) ELSE v.value END AS v FROM (
    SELECT r.document_id, r.extraction_id, coalesce(n.new_coa_id, r.coa_id) AS coa_id FROM routed r LEFT JOIN res n USING (document_id, extraction_id) WHERE coalesce(n.new_coa_id, r.coa_id) IS NOT NULL) m
  JOIN fx_row_values v USING (document_id, extraction_id) LEFT JOIN fx_coa k ON k.coa_id = m.coa_id WHERE m.document_id IN (SELECT document_id FROM fx_decisions)) s
JOIN fx_coa c ON c.coa_id = s.coa_id AND c.statement = 'Balance Sheet' GROUP BY s.document_id, s.year""", DEC, RES)
def e25(t):
    b = S.refresh_checks(S.changed_documents(t.decisions), resolved(t)["rows"], t.row_values, t.coa)
    return b.select("document_id", "year", F.round("total_assets", 2).alias("total_assets"))


_AFTER = """SELECT r.* REPLACE (CASE WHEN n.new_coa_id IS NOT NULL THEN 'mapped' ELSE r.status END AS status) FROM routed r LEFT JOIN res n USING (document_id, extraction_id)"""


@query("e25_refresh_reconciliation", "SELECT * FROM recon WHERE document_id IN (SELECT document_id FROM fx_decisions)", DEC,
       {**RES, "after": _AFTER, **{k: v.replace("FROM routed", "FROM after") if k == "outc" else v for k, v in CROSSFOOT.items() if k != "routed"}})
def e25b(t):
    _, report = S.refresh_reconciliation(S.changed_documents(t.decisions), resolved(t)["rows"], recon_rows(t), t.row_values)
    return Q.recon_summary(report)


# -- stored tables, changed in place of a recomputation ------------------------------------------------------------

def _stored(t, df, name, keys):
    """A table in buckets by document, and the rows of a change applied to it."""
    return BucketTable.create(df, os.path.join(work_dir(t.spark), f"{name}-{uuid.uuid4().hex}"), keys, ["document_id"], buckets=32)


def stored_rows(t):
    """The routed rows as a stored table, then only the rows that decisions resolve written over them."""
    rows = _stored(t, routed(t), "stored-rows", ["document_id", "extraction_id"])
    rows.upsert(resolved(t)["rows"].filter("mapping_source = 'manual'"))
    return rows


@query("e23_stored_rows", """SELECT r.document_id, r.extraction_id, CASE WHEN n.document_id IS NULL THEN r.status ELSE 'mapped' END AS status, coalesce(n.new_coa_id, r.coa_id) AS coa_id,
  CAST(CASE WHEN n.document_id IS NULL THEN r.confidence ELSE 0.95 END AS DOUBLE) AS confidence FROM routed r LEFT JOIN res n USING (document_id, extraction_id)""", DEC, RES)
def e23f(t):
    return stored_rows(t).read().select("document_id", "extraction_id", "status", "coa_id", "confidence")


@query("a07_stored_delete", """SELECT document_id, extraction_id, raw_label FROM fx_rows WHERE document_id NOT IN (SELECT document_id FROM fx_documents WHERE template_type = 'T2')""", ("fx_rows", "fx_documents"))
def a07c(t):
    rows = _stored(t, t.rows, "stored-lines", ["document_id", "extraction_id"])
    rows.delete(t.documents.filter("template_type = 'T2'").select("document_id"))
    return rows.read().select("document_id", "extraction_id", "raw_label")


_ALL_AFTER = """SELECT m.document_id, m.extraction_id, m.coa_id, v.year, v.value AS raw_value, CASE WHEN k.sign_convention IN ('contra', 'negative') THEN -abs(v.value) ELSE v.value END AS value FROM (
    SELECT r.document_id, r.extraction_id, coalesce(n.new_coa_id, r.coa_id) AS coa_id FROM routed r LEFT JOIN res n USING (document_id, extraction_id) WHERE coalesce(n.new_coa_id, r.coa_id) IS NOT NULL) m
  JOIN fx_row_values v USING (document_id, extraction_id) LEFT JOIN fx_coa k ON k.coa_id = m.coa_id"""


@query("e25_stored_balance", "SELECT document_id, year, round(total_assets, 2) AS total_assets, difference, is_balanced, headline FROM bal", DEC, {**RES, "signed": _ALL_AFTER, "bal": BALANCE})
def e25c(t):
    """Every document's balance, of which only the decided documents' is worked out again."""
    done = _stored(t, A.balance_identity(signed(t), t.coa), "stored-balance", ["document_id", "year"])
    values = _stored(t, t.row_values.select("document_id", "extraction_id", "year", "value"), "stored-values", ["document_id", "extraction_id", "year"])
    S.refresh_stored(S.changed_documents(t.decisions), stored_rows(t), values, t.coa, done)
    return done.read().select("document_id", "year", F.round("total_assets", 2).alias("total_assets"), "difference", "is_balanced", "headline")


@query("e26_skip_items", """SELECT document_id, extraction_id, CASE WHEN status = 'unmapped' AND (document_id, extraction_id) IN (SELECT (document_id, extraction_id) FROM fx_decisions WHERE action = 'skip') THEN 'set_aside' ELSE status END AS status FROM routed""", DEC, RT)
def e26(t):
    return S.skip_items(routed(t), t.decisions).select("document_id", "extraction_id", "status")


UP = """SELECT p.document_id, p.extraction_id, p.raw_label, p.best_coa_id AS coa_id, p.best_score FROM pend p WHERE p.best_score >= 0.55"""
REP = {**AG, **PE, "up": UP}


def republished(t):
    waiting = pending(t).withColumn("best_reason", F.concat(F.lit("Row "), F.col("extraction_id").cast("string"), F.lit(" fits.")))
    return S.republish(routed(t), aggregated(t), A.mapping_heads(routed(t)), waiting, t.row_values, t.coa)


@query("f09_republish_values", """SELECT document_id, coa_id, year, round(sum(value), 2) AS value FROM (SELECT document_id, coa_id, year, value FROM signed
UNION ALL SELECT v.document_id, u.coa_id, v.year, CASE WHEN c.sign_convention = 'contra' THEN -abs(v.value) ELSE v.value END FROM up u JOIN fx_row_values v USING (document_id, extraction_id) JOIN fx_coa c ON c.coa_id = u.coa_id) x GROUP BY ALL""", SUG, REP)
def f09(t):
    return republished(t)["values"].withColumn("value", F.round("value", 2))


@query("f09_republish_heads", """SELECT document_id, coa_id, coalesce(n1, 0) + coalesce(n2, 0) AS aggregated_from, coalesce(c1, c2) AS confidence, coalesce(l1, l2) AS raw_label, coalesce(s1, s2) AS statement_type, 'model' AS mapping_source,
  CASE WHEN n1 IS NULL THEN concat('Row ', e2, ' fits. [Threshold-promoted at 0.55.]') WHEN n1 > 1 THEN concat('[Aggregated from ', n1, ' source rows.]') ELSE '' END AS rationale_note
FROM (SELECT document_id, coa_id, count(*) AS n1, arg_min(confidence, extraction_id) AS c1, arg_min(raw_label, extraction_id) AS l1, arg_min(statement_type, extraction_id) AS s1 FROM routed WHERE status = 'mapped' GROUP BY ALL) a
FULL JOIN (SELECT u.document_id, u.coa_id, count(*) AS n2, max(best_score) AS c2, arg_min(u.raw_label, u.extraction_id) AS l2, arg_min(r.statement_type, u.extraction_id) AS s2, arg_max(u.extraction_id, (best_score, -u.extraction_id)) AS e2
  FROM up u JOIN fx_rows r USING (document_id, extraction_id) GROUP BY ALL) b USING (document_id, coa_id)""", SUG, REP)
def f09b(t):
    return republished(t)["heads"].select("document_id", "coa_id", "aggregated_from", "confidence", "raw_label", "statement_type", "mapping_source", "rationale_note")


@query("f09_republish_sources", """SELECT document_id, coa_id, promoted, CAST((extraction_id - 1) // 10000 AS INT) AS part_no, string_agg(raw_label, ' + ' ORDER BY extraction_id) AS labels, string_agg(extraction_id::VARCHAR, ',' ORDER BY extraction_id) AS ids
FROM (SELECT document_id, coa_id, extraction_id, raw_label, false AS promoted FROM routed WHERE status = 'mapped' UNION ALL SELECT document_id, coa_id, extraction_id, raw_label, true FROM up) x GROUP BY ALL""", SUG, REP)
def f09f(t):
    return republished(t)["sources"].select("document_id", "coa_id", "promoted", "part_no", "labels", F.array_join("source_extraction_ids", ",").alias("ids"))


# Strings are made anew on the way: DuckDB's dictionary cache sometimes fails on those of a union's two sides.
_PUBLISHED = """SELECT document_id, coa_id || '' AS coa_id, year || '' AS year, value FROM signed UNION ALL
SELECT v.document_id, u.coa_id || '', v.year || '', CASE WHEN c.sign_convention = 'contra' THEN -abs(v.value) ELSE v.value END FROM up u JOIN fx_row_values v USING (document_id, extraction_id) JOIN fx_coa c ON c.coa_id = u.coa_id"""


@query("f09_republish_balance", "SELECT document_id, year, round(total_assets, 2) AS total_assets, difference, is_balanced FROM bal", SUG,
       {**REP, "published": _PUBLISHED, "bal": BALANCE.replace("FROM signed s JOIN fx_coa c", "FROM published s JOIN (SELECT coa_id || '' AS coa_id, broad_category || '' AS broad_category, is_subtotal, statement FROM fx_coa) c")})
def f09d(t):
    return republished(t)["balance"].select("document_id", "year", F.round("total_assets", 2).alias("total_assets"), "difference", "is_balanced")


_OUTC = f"""SELECT o.document_id, o.label, o.statement_type, CASE WHEN EXISTS (SELECT 1 FROM up u JOIN fx_rows r USING (document_id, extraction_id)
  WHERE u.document_id = o.document_id AND lower(trim(u.raw_label)) = o.label AND r.statement_type = o.statement_type) THEN 'mapped' ELSE o.status END AS status FROM ({CROSSFOOT["outc"]}) o"""


@query("f09_republish_flags", "SELECT document_id, subtotal_id, has_unmapped, passed FROM report", SUG,
       {**REP, **{k: _OUTC if k == "outc" else v for k, v in CROSSFOOT.items() if k != "routed"}})
def f09e(t):
    comps, subs = grouped(t)
    return Q.crossfoot(comps, subs, t.rows, t.row_values, republished(t)["outcomes"], t.stored)[1].select("document_id", "subtotal_id", "has_unmapped", "passed")


@query("f09_republish_documents", """SELECT document_id, coalesce(n, 0) AS promoted, c - coalesce(n, 0) AS unmapped_count, CASE WHEN c - coalesce(n, 0) = 0 THEN 'spread_complete' ELSE 'has_unmapped' END AS spread_status
FROM (SELECT document_id, count(*) FILTER (status = 'unmapped') AS c FROM routed GROUP BY 1) a LEFT JOIN (SELECT document_id, count(*) AS n FROM up GROUP BY 1) b USING (document_id)""", SUG, REP)
def f09c(t):
    return republished(t)["documents"]


# -- streams: the given tables as files, read as a stream to the end ------------------------------------------------

def _folder(t, name):
    return os.path.join(work_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


def _as_stream(t, df, name, sort=None, files=4):
    """Write a table as files and read them as a stream, several files at a time, in event order where given."""
    path = _folder(t, name)
    df = df.repartitionByRange(files, sort).sortWithinPartitions(sort) if sort else df.repartition(files)
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("g01_ingest_pages", f"""SELECT document_id, page_number, cls AS classification, section_type, {SCOPE} AS scope FROM (SELECT *, left(text, 500) AS h FROM o_sec) t""", PAGES, SEC)
def g01(t):
    """Every page delivered twice."""
    p = t.pages.withColumn("arrived_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    out, check = _folder(t, "g01"), _folder(t, "g01-check")
    T.run_to_end(T.ingest_pages(_as_stream(t, p.unionByName(p), "pages-in")), "append", out, check)
    return t.spark.read.parquet(out).select("document_id", "page_number", "classification", "section_type", "scope")


def _meter(t, make, mode="append"):
    out, check = _folder(t, "meter"), _folder(t, "meter-check")
    late = t.usage.agg(F.max(F.col("ts").cast("timestamp")).alias("m"))
    # A closing event far ahead moves the watermark past every window.
    last = late.select(F.lit(-1).cast("bigint").alias("event_id"), (F.col("m") + F.expr("INTERVAL 30 DAYS")).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("bigint").alias("document_id"),
                       F.lit("close").alias("stage"), F.lit("model-unknown").alias("model"), *[F.lit(0).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation")])
    T.run_to_end(make(_as_stream(t, t.usage.unionByName(last), "usage-in", "ts")), mode, out, check)
    return t.spark.read.parquet(out).filter("stage <> 'close'")


_W = """SELECT CAST(w AS VARCHAR) AS window_start, stage, regexp_replace(model, '^.*\\.', '') AS model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM ({0}) x GROUP BY ALL"""


@query("g02_usage_tumbling", _W.format("SELECT date_trunc('day', ts) AS w, * FROM fx_usage"), ("fx_usage",))
def g02(t):
    m = _meter(t, lambda s: T.usage_meter(s))
    return m.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "stage", "model", "calls", "input_tokens")


@query("g02_usage_sliding", _W.format("SELECT date_trunc('day', ts) + to_hours(CAST(h AS BIGINT)) AS w, u.* FROM fx_usage u CROSS JOIN (SELECT unnest([-12, 0, 12]) AS h) k WHERE date_trunc('day', ts) + to_hours(CAST(h AS BIGINT)) <= ts AND ts < date_trunc('day', ts) + to_hours(CAST(h + 24 AS BIGINT))"), ("fx_usage",))
def g02b(t):
    m = _meter(t, lambda s: T.usage_meter(s, "1 day", "12 hours"))
    return m.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "stage", "model", "calls", "input_tokens")


@query("g02_usage_sessions", """SELECT document_id, stage, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS calls FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, stage ORDER BY ts, event_id) AS s FROM (
    SELECT *, lag(ts) OVER (PARTITION BY document_id, stage ORDER BY ts, event_id) AS prev FROM fx_usage) a) b GROUP BY document_id, stage, s""", ("fx_usage",))
def g02c(t):
    m = _meter(t, lambda s: T.usage_sessions(s))
    return m.select("document_id", "stage", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "calls")


@query("g03_apply_decisions", """SELECT document_id, extraction_id, action, coa_id, decision_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, extraction_id ORDER BY decided_at DESC, decision_id DESC) AS rn FROM fx_decisions) x WHERE rn = 1""", ("fx_decisions",))
def g03(t):
    table, check = _folder(t, "decided"), _folder(t, "decided-check")
    T.apply_decisions(_as_stream(t, t.decisions, "decisions-in", "decided_at"), table, check).awaitTermination()
    return T.current_decisions(t.spark, table).select("document_id", "extraction_id", "action", "coa_id", "decision_id")


_LAST = """SELECT document_id, extraction_id, arg_max(coa_id, (decided_at, decision_id)) FILTER (action = 'resolve') AS res, arg_max(coa_id, (decided_at, decision_id)) FILTER (action = 'override') AS ov,
  bool_or(action = 'skip') AS skip FROM fx_decisions GROUP BY document_id, extraction_id"""
_DECIDED = """SELECT r.document_id, r.extraction_id, CASE WHEN r.status <> 'unmapped' THEN r.status WHEN l.res IS NOT NULL THEN 'mapped' WHEN l.skip THEN 'set_aside' ELSE r.status END AS status,
  CASE WHEN r.status = 'unmapped' AND l.res IS NOT NULL THEN l.res WHEN r.status = 'mapped' AND l.ov IS NOT NULL THEN l.ov ELSE r.coa_id END AS coa_id,
  CAST(CASE WHEN (r.status = 'unmapped' AND l.res IS NOT NULL) OR (r.status = 'mapped' AND l.ov IS NOT NULL) THEN 0.95 ELSE r.confidence END AS DOUBLE) AS confidence
FROM routed r LEFT JOIN last l USING (document_id, extraction_id)"""


def decided_rows(t):
    """All rows as a stored table after the stream of all decisions, and what became of each decision."""
    rows = routed(t).select("document_id", "extraction_id", "status", "coa_id", "confidence", "mapping_source")
    table, notes = _stored(t, rows, "decided-rows", ["document_id", "extraction_id"]), _folder(t, "decided-notes")
    d = t.decisions.select("document_id", "extraction_id", "action", "coa_id", F.col("decided_at").cast("timestamp").alias("decided_at"), "decision_id")
    # A row decided long after all others moves the watermark past them.
    end = rows.orderBy("document_id", "extraction_id").limit(1).select("document_id", "extraction_id", F.lit("close").alias("action"), F.lit(None).cast("string").alias("coa_id"), F.lit(d.agg(F.max("decided_at")).first()[0] + timedelta(days=8000)).alias("decided_at"), F.lit(-1).cast("bigint").alias("decision_id"))
    # The patience covers the whole table, as the files of a table arrive in no order; the last row comes after them.
    path = _folder(t, "decisions-in")
    d.repartition(8).write.parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    arriving = t.spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 3).parquet(path)
    results = D.decision_results(arriving, rows, patience_days=3650, retention_days=3650, keep_days=36500)
    D.decide_into(results, table, notes, _folder(t, "decided-state")).awaitTermination()
    return table.read(), t.spark.read.schema(D.RESULT).parquet(notes)


@query("g03_decided_rows", "SELECT * FROM decided", DEC, {**RT, "last": _LAST, "decided": _DECIDED})
def g03c(t):
    return decided_rows(t)[0].select("document_id", "extraction_id", "status", "coa_id", "confidence")


@query("g03_learning_counters", """SELECT learned_id, count(*) FILTER (k = 'applied') AS times_applied, count(*) FILTER (k = 'overridden') AS times_overridden,
  CAST(CASE WHEN count(*) FILTER (k = 'overridden') >= 2 THEN 0.70 WHEN count(*) FILTER (k = 'applied') >= 5 AND count(*) FILTER (k = 'overridden') = 0 THEN 0.99 ELSE 0.95 END AS DOUBLE) AS learned_confidence
FROM (SELECT user_id AS learned_id, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'overridden' ELSE 'applied' END AS k FROM events) e GROUP BY 1""")
def g03b(t):
    e = t.raw("events").select(F.col("user_id").alias("learned_id"), F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "overridden").otherwise("applied").alias("kind"))
    out, check = _folder(t, "counters"), _folder(t, "counters-check")
    T.run_to_end(T.learning_counters(_as_stream(t, e, "learning-in", files=2)), "update", out, check)
    r = t.spark.read.parquet(out)
    return r.groupBy("learned_id").agg(F.max_by(F.struct("times_applied", "times_overridden", "learned_confidence"), "batch").alias("c")).select("learned_id", "c.*")


@query("g04_latest_stage", "SELECT document_id, arg_max(stage, (ts, event_id)) AS stage FROM fx_usage GROUP BY 1", ("fx_usage",))
def g04(t):
    out, check = _folder(t, "stage"), _folder(t, "stage-check")
    s = _as_stream(t, t.usage.select("document_id", "stage", F.col("ts").cast("timestamp").alias("ts"), "event_id"), "stage-in", "ts")
    T.run_to_end(T.latest_stage(s), "update", out, check)
    r = t.spark.read.parquet(out)
    return r.groupBy("document_id").agg(F.max_by("stage", F.struct("ts", "batch")).alias("stage"))


#: Files by the last two digits of the id: some lines cut off, one file all of them; file 18 is delivered again as 19.
_DELIVERED = """SELECT doc_id AS document_id, doc_id % 19 AS batch, doc_id % 11 = 3 OR doc_id % 19 = 7 AS broken FROM documents
UNION ALL SELECT doc_id, 19, doc_id % 11 = 3 FROM documents WHERE doc_id % 19 = 18"""


def delivered(t):
    """The documents as JSON lines in a folder of files, in two deliveries; the first one is taken in before the second comes."""
    d = t.raw("documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")
    i = F.col("document_id")
    lines = d.withColumns({"batch": i % 19, "broken": (i % 11 == 3) | (i % 19 == 7)}).unionByName(d.filter(i % 19 == 18).withColumns({"batch": F.lit(19).cast("bigint"), "broken": i % 11 == 3}))
    whole = F.to_json(F.struct("document_id", "page_number", "text"))
    lines = lines.select("batch", F.when(F.col("broken"), F.left(whole, F.length(whole) - 2)).otherwise(whole).alias("value"))
    box = _folder(t, "inbox")
    put = lambda part: part.repartition(8, "batch").sortWithinPartitions("batch").write.mode("append").partitionBy("batch").text(box)
    put(lines.filter("batch < 5"))
    first = intake.ingest_folder(t.spark, box)
    loaded, ledger = materialise(first[0]), materialise(first[2])
    put(lines.filter("batch >= 5"))
    return loaded, intake.ingest_folder(t.spark, box, ledger, loaded)


@query("a11_ingest_folder", """SELECT batch, CASE WHEN batch < 5 THEN 'seen' WHEN bool_and(broken) THEN 'failed' WHEN batch = 19 THEN 'repeated' WHEN bool_or(broken) THEN 'partial' ELSE 'loaded' END AS status,
  CASE WHEN batch < 5 THEN 0 ELSE count(*) END AS n_lines, CASE WHEN batch < 5 THEN 0 ELSE count(*) FILTER (broken) END AS n_bad, CASE WHEN batch < 5 OR batch = 19 THEN 0 ELSE count(*) FILTER (NOT broken) END AS n_rows
FROM delivered GROUP BY batch""", (), {"delivered": _DELIVERED})
def a11b(t):
    return delivered(t)[1][1].select(F.regexp_extract("path", r"batch(?:=|%3D)(\d+)", 1).cast("bigint").alias("batch"), "status", "n_lines", "n_bad", "n_rows")


@query("a11_ingested_rows", """SELECT d.doc_id AS document_id, md5(coalesce(d.text, '')) AS digest FROM documents d JOIN (SELECT DISTINCT document_id FROM delivered WHERE NOT broken) k ON k.document_id = d.doc_id""", (), {"delivered": _DELIVERED})
def a11c(t):
    loaded, (rows, _, _) = delivered(t)
    return loaded.unionByName(rows).select("document_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("g04_latest_stage_expiring", "SELECT document_id, arg_max(stage, (ts, event_id)) AS stage FROM fx_usage GROUP BY 1", ("fx_usage",))
def g04b(t):
    """Every change of stage as appended rows; the delay covers the table, as its files arrive in no order."""
    out, check = _folder(t, "stages"), _folder(t, "stages-check")
    s = _as_stream(t, t.usage.select("document_id", "stage", F.col("ts").cast("timestamp").alias("ts"), "event_id"), "stage-in", "ts")
    with D.keyed_state(t.spark):
        T.run_to_end(G.latest_stages(s, "3650 days"), "append", out, check)
    r = t.spark.read.parquet(out)
    return r.groupBy("document_id").agg(F.max_by("stage", F.struct("ms", "event_id")).alias("stage"))
