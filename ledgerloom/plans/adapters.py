"""The engine's input tables derived from the driver's tables, and the same derivations as SQL for checking."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import BUCKET_CONF, materialise, stored_by, tune

PAGE_CHARS = 1500
#: Line items of a bucket, about, and the stages that are stored in buckets of documents.
LINES_PER_BUCKET = 100_000
BY_DOCUMENT = ("rows", "routed", "signed", "components", "subtotals", "flat_components", "flat_subtotals", "crossfoot_years", "crossfoot", "learned_hits", "pending")
ROW_COLS = ["document_id", "statement_type", "section_no", "raw_label", "is_subtotal", "indentation_level"]

_shared: dict[tuple[str, str], "Tables"] = {}


def tables(spark: SparkSession, sf_dir: str) -> "Tables":
    """One Tables object per session and folder, so that stage boundaries are written once."""
    tune(spark, BUCKET_CONF)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        _shared[key] = Tables(spark, sf_dir)
    return _shared[key]


class Tables:
    """Lazy input tables. Line items with their values and the classified pages are written once as stage boundaries; the rest are plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._stages: dict[str, DataFrame] = {}
        self.tag = re.sub(r"\W+", "_", self.dir)

    def stage(self, name: str, build) -> DataFrame:
        """A stage boundary: built and written at first use, read back from then on."""
        if name not in self._stages:
            df = build()
            self._stages[name] = self.stored(df) if name in BY_DOCUMENT else materialise(df, f"{name}-{self.tag}")
        return self._stages[name]

    def stored(self, df: DataFrame) -> DataFrame:
        """A frame written in the buckets of its documents, as the rows are."""
        return stored_by(df, "document_id", self.buckets)

    @cached_property
    def buckets(self) -> int:
        """Buckets of the stages stored by document."""
        return self.raw("lineitem").count() // LINES_PER_BUCKET + 1

    def stages(self, names: tuple[str, ...], build) -> tuple[DataFrame, ...]:
        """Stage boundaries that one call builds together; the call is made at first use only."""
        if any(n not in self._stages for n in names):
            for n, df in zip(names, build(), strict=True):
                self.stage(n, lambda df=df: df)
        return tuple(self._stages[n] for n in names)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- documents ----------------------------------------------------------------------------------
    @cached_property
    def documents(self) -> DataFrame:
        last = self.raw("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("created_at"))
        c = self.raw("customer").join(last, F.col("o_custkey") == F.col("c_custkey"))
        year = F.year("created_at")
        return c.select(
            F.col("c_custkey").alias("document_id"), F.col("c_name").alias("company"),
            F.concat("c_name", F.lit("_"), year.cast("string"), F.lit(".pdf")).alias("filename"),
            year.cast("int").alias("fiscal_year"),
            F.concat(F.lit("T"), (F.col("c_nationkey") % 8 + 1).cast("string")).alias("template_type"),
            F.element_at(F.array(*map(F.lit, ["USD", "GBP", "INR", "XXX"])), (F.col("c_nationkey") % 4 + 1).cast("int"))
            .alias("currency_code"),
            "created_at")

    @cached_property
    def runs(self) -> DataFrame:
        """One processing run per order: several per filename."""
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("run_id"),
            F.concat(F.lit("filing_"), F.col("o_custkey").cast("string"), F.lit("_"),
                     F.year("o_orderdate").cast("string"), F.when(F.col("o_custkey") % 10 == 0, ".txt").otherwise(".pdf"))
            .alias("filename"),
            F.col("o_orderdate").alias("created_at"),
            F.element_at(F.array(*map(F.lit, ["done", "processing", "error", "queued"])),
                         F.when(F.col("o_orderkey") % 9 < 6, 1).otherwise((F.col("o_orderkey") % 9 - 4).cast("int")))
            .alias("run_status"),
            F.when(F.col("o_orderkey") % 9 == 7, F.lit("timeout")).alias("error_message"))

    # -- rows ---------------------------------------------------------------------------------------
    @cached_property
    def _numbered(self) -> DataFrame:
        """Numbered rows with their years and values as a list; one exchange of the line items, by document."""
        kinds = {"ECONOMY": "balance_sheet", "SMALL": "balance_sheet", "MEDIUM": "income_statement",
                 "LARGE": "income_statement", "PROMO": "cash_flow"}
        kind = F.lit("equity_statement")
        for k, v in kinds.items():
            kind = F.when(F.col("p_type") == k, v).otherwise(kind)
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        base = li.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("o_custkey").alias("document_id"), kind.alias("statement_type"), (F.col("p_size") % 5).alias("section_no"), F.col("p_name").alias("raw_label"),
            F.year("l_shipdate").cast("string").alias("year"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amt"))
        section = ["document_id", "statement_type", "section_no"]
        leaf = base.repartition(self.buckets, "document_id").groupBy(*section, "raw_label", "year").agg(F.sum("amt").alias("amt"))
        # Every leaf counts for itself and for its section's total; the rows stay where their document is.
        doc, no, sub = F.col("document_id"), F.col("section_no"), F.col("is_subtotal")
        both = leaf.withColumn("is_subtotal", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
            "raw_label", F.when(sub, F.concat(F.lit("Total section "), no.cast("string"))).otherwise(F.col("raw_label")))
        factor = F.when(sub & ((doc + no) % 7 == 0), 2).otherwise(1)
        values = both.groupBy(*section, "is_subtotal", "raw_label", "year").agg(F.sum("amt").alias("amt")).withColumn("value", (F.col("amt") * factor).cast("double"))
        head = values.groupBy(*section, "is_subtotal", "raw_label").agg(F.collect_list(F.struct("year", "value")).alias("years"))
        number = F.row_number().over(Window.partitionBy("document_id").orderBy("statement_type", "section_no", "is_subtotal", "raw_label"))
        level = F.when(sub, 0).otherwise(1).alias("indentation_level")
        return head.select(*section, "raw_label", "is_subtotal", level, number.alias("extraction_id"), "years")

    @property
    def _rows_written(self) -> DataFrame:
        return self.stage("rows", lambda: self._numbered)

    @property
    def rows(self) -> DataFrame:
        return self._rows_written.select(*ROW_COLS, "extraction_id")

    @property
    def row_values(self) -> DataFrame:
        """Rows by year; those without a complete key have none."""
        return self._rows_written.dropna(subset=ROW_COLS).select(*ROW_COLS, F.inline("years"), "extraction_id")

    # -- pages --------------------------------------------------------------------------------------
    @cached_property
    def pages(self) -> DataFrame:
        """The whole text of every document cut into pages, some with an injected heading."""
        d = self.raw("documents").select(
            F.col("doc_id").alias("document_id"), "text",
            F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PAGE_CHARS).cast("int")))
            .alias("n"))
        slot = (F.col("document_id") + F.col("n")) % 9
        heading = (F.when(slot == 0, "Consolidated Balance Sheets").when(slot == 2, "Company Income Statement")
                   .when(slot == 4, "Group Statements of Cash Flows").when(slot == 6, "Statement of Changes in Equity")
                   .when(slot == 7, F.concat(F.lit("Note "), (F.col("n") + 1).cast("string"))).otherwise(""))
        body = F.substring(F.col("text"), F.col("n") * PAGE_CHARS + 1, F.lit(PAGE_CHARS))
        return d.select("document_id", (F.col("n") + 1).alias("page_number"),
                        F.concat(heading, F.lit("\n"), body).alias("text"),
                        ((F.col("document_id") * 7 + F.col("n") * 13) % 400).cast("int").alias("drawing_count"))

    # -- chart, suggestions, learning -----------------------------------------------------------------
    def _sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: self.raw(n) for n in names})

    @property
    def coa(self) -> DataFrame:
        """The chart, written once: its size is known to the joins, so that rows need not move to meet a small one."""
        return self.stage("coa", lambda: self._sql(COA_SQL.replace("FROM part", "FROM {part}"), "part"))

    @cached_property
    def suggestions(self) -> DataFrame:
        r = (self.rows.filter(F.col("statement_type").isin("balance_sheet", "income_statement"))
             .select("document_id", "extraction_id", "statement_type", F.explode(F.array(*map(F.lit, [1, 2, 3]))).alias("cand_rank"))
             .withColumn("statement", F.when(F.col("statement_type") == "balance_sheet", "Balance Sheet").otherwise("P&L"))
             .withColumn("coa_no", (F.col("extraction_id") * 5 + F.col("cand_rank")) % 64 + 1))
        c = self.coa.select("coa_id", "statement", F.substr("coa_id", F.lit(4)).cast("int").alias("coa_no"))
        score = ((F.col("document_id") * 31 + F.col("extraction_id") * 17 + F.col("cand_rank") * 7) % 100).cast("double") / 100
        return r.join(c, ["statement", "coa_no"]).select("document_id", "extraction_id", "cand_rank", "coa_id", score.alias("score"))

    @cached_property
    def answers(self) -> DataFrame:
        """The first candidate of each row, as an answer table."""
        return self.suggestions.filter("cand_rank = 1").select("document_id", "extraction_id", "coa_id",
                                                               F.col("score").alias("confidence"))

    @cached_property
    def learned(self) -> DataFrame:
        return self._sql(LEARNED_SQL.replace("FROM part", "FROM {part}"), "part")

    @cached_property
    def labels(self) -> DataFrame:
        return self._sql(LABELS_SQL.replace("FROM part", "FROM {part}"), "part")

    # -- canonical values -------------------------------------------------------------------------------
    @cached_property
    def canonical(self) -> DataFrame:
        money = F.col("o_totalprice").cast("decimal(18,2)")
        sums = self.raw("orders").groupBy("o_custkey").agg(
            F.sum(money).cast("double").alias("tp"),
            F.sum(F.when(F.col("o_orderstatus") == "F", money).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("fp"))
        b = self.raw("customer").join(sums, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_custkey").alias("document_id"),
            F.concat(F.lit("T"), (F.col("c_nationkey") % 8 + 1).cast("string")).alias("template_type"), "tp", "fp")
        tp, fp, doc, always = F.col("tp"), F.col("fp"), F.col("document_id"), F.lit(True)
        fields = [("current_assets", fp, always), ("non_current_assets", tp - fp, doc % 11 != 0),
                  ("total_assets", F.when(doc % 5 == 0, tp * 2).otherwise(tp), always), ("total_liabilities", fp, always),
                  ("total_equity", tp - fp, always), ("partners_capital", tp - fp, F.col("template_type") == "T6"),
                  ("total_income", tp, always), ("total_expenses", fp, always), ("profit_before_tax", tp - fp, always),
                  ("cash_end", F.lit(None).cast("double"), doc % 2 == 0)]
        items = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(n).alias("canonical_field"), v.alias("value")))
                                          for n, v, cond in fields]))
        return b.select("document_id", "template_type", F.inline(items))

    # -- events -------------------------------------------------------------------------------------------
    @cached_property
    def usage(self) -> DataFrame:
        return self._sql(USAGE_SQL.replace("FROM events", "FROM {events}"), "events")

    @cached_property
    def decisions(self) -> DataFrame:
        return self._sql(DECISIONS_SQL.replace("FROM events", "FROM {events}"), "events")


# The statements below run unchanged in Spark SQL and in DuckDB.

COA_SQL = """
SELECT concat(CASE WHEN statement = 'Balance Sheet' THEN 'BS-' ELSE 'PL-' END,
              printf('%03d', row_number() OVER (PARTITION BY statement ORDER BY line_item_name))) AS coa_id,
       line_item_name, statement,
       CASE WHEN statement = 'P&L' THEN 'Revenue' WHEN h = 0 THEN 'Current Assets' WHEN h = 1 THEN 'Non-Current Assets'
            WHEN h = 2 THEN 'Current Liabilities' WHEN h = 3 THEN 'Non-Current Liabilities' ELSE 'Equity' END AS broad_category,
       CASE WHEN line_item_name LIKE 'old%' THEN 'contra' ELSE 'positive' END AS sign_convention,
       line_item_name LIKE 'new%' AS is_subtotal
FROM (SELECT p_name AS line_item_name, 'Balance Sheet' AS statement, min(p_size % 5) AS h FROM part GROUP BY p_name
      UNION ALL
      SELECT p_name AS line_item_name, 'P&L' AS statement, min(p_size % 5) AS h FROM part GROUP BY p_name) t
"""

LEARNED_SQL = """
SELECT p_partkey AS learned_id, p_name AS label_key,
       CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE concat('T', CAST(1 + p_partkey % 8 AS STRING)) END AS template_type,
       CASE WHEN p_size % 2 = 0 THEN 'balance_sheet' ELSE 'income_statement' END AS statement_type,
       concat(CASE WHEN p_size % 2 = 0 THEN 'BS-' ELSE 'PL-' END, printf('%03d', 1 + p_partkey % 64)) AS coa_id,
       CAST(0.95 AS DOUBLE) AS learned_confidence, p_size % 7 AS times_applied,
       CASE WHEN p_partkey % 13 = 0 THEN 2 ELSE 0 END AS times_overridden, p_partkey AS created_seq,
       concat('filing_', CAST(p_size AS STRING), '.pdf') AS source_document, p_brand AS rationale
FROM part
"""

LABELS_SQL = """
SELECT p_partkey AS row_id, concat('T', CAST(1 + p_partkey % 8 AS STRING)) AS template_type,
       CASE p_size % 4 WHEN 0 THEN 'income_statement' WHEN 1 THEN 'balance_sheet' WHEN 2 THEN 'cash_flow' ELSE 'equity_statement' END AS statement_type,
       CASE WHEN p_size % 3 = 0 THEN 'Cash flows from Investing activities' ELSE 'Main' END AS section,
       concat(CASE p_partkey % 4 WHEN 0 THEN 'VII. ' WHEN 1 THEN '12. ' WHEN 2 THEN '(a) ' ELSE '' END,
              CASE p_partkey % 10 WHEN 0 THEN 'Interest income' WHEN 1 THEN 'Turnover' WHEN 2 THEN 'Total  Assets' WHEN 3 THEN 'PBT'
                   WHEN 4 THEN 'Total equity' WHEN 5 THEN 'Other income' WHEN 6 THEN 'Net income attributable to owners'
                   WHEN 7 THEN 'Finance costs' WHEN 8 THEN 'Income tax expense' ELSE p_name END,
              CASE p_partkey % 3 WHEN 0 THEN ' (Note 21)' WHEN 1 THEN ' (Restated)' ELSE '' END) AS raw_label
FROM part
"""

USAGE_SQL = """
SELECT event_id, ts, user_id AS document_id,
       CASE WHEN event_type IN ('view','click') THEN 'extraction' WHEN event_type = 'error' THEN 'other' ELSE 'spreading' END AS stage,
       CASE user_id % 3 WHEN 0 THEN 'model-large' WHEN 1 THEN 'vendor.model-small' ELSE 'model-unknown' END AS model,
       CAST(round(value * 10) AS BIGINT) AS input_tokens, CAST(round(value) AS BIGINT) AS output_tokens,
       CAST(event_id % 50 AS BIGINT) AS cache_read, CAST(event_id % 20 AS BIGINT) AS cache_creation
FROM events
"""

DECISIONS_SQL = """
SELECT event_id AS decision_id, ts AS decided_at, user_id AS document_id,
       CASE event_type WHEN 'purchase' THEN 'resolve' WHEN 'click' THEN 'override' ELSE 'skip' END AS action,
       CAST(1 + event_id % 40 AS INT) AS extraction_id, concat('BS-', printf('%03d', 1 + event_id % 64)) AS coa_id
FROM events WHERE event_type IN ('purchase','click','signup')
"""

# Names of the checking side only: (statement, names it builds on).
ORACLE_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_documents": ("""
SELECT c.c_custkey AS document_id, c.c_name AS company,
       concat(c.c_name, '_', CAST(max(year(o.o_orderdate)) AS STRING), '.pdf') AS filename,
       CAST(max(year(o.o_orderdate)) AS INT) AS fiscal_year,
       concat('T', CAST(1 + c.c_nationkey % 8 AS STRING)) AS template_type,
       CASE c.c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' WHEN 2 THEN 'INR' ELSE 'XXX' END AS currency_code,
       max(o.o_orderdate) AS created_at
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_name, c.c_nationkey""", ()),
    "fx_runs": ("""
SELECT o_orderkey AS run_id,
       concat('filing_', CAST(o_custkey AS STRING), '_', CAST(year(o_orderdate) AS STRING),
              CASE WHEN o_custkey % 10 = 0 THEN '.txt' ELSE '.pdf' END) AS filename,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey % 9 < 6 THEN 'done' WHEN o_orderkey % 9 = 6 THEN 'processing'
            WHEN o_orderkey % 9 = 7 THEN 'error' ELSE 'queued' END AS run_status,
       CASE WHEN o_orderkey % 9 = 7 THEN 'timeout' END AS error_message
FROM orders""", ()),
    "fx_values": ("""
SELECT document_id, statement_type, section_no, raw_label, false AS is_subtotal, 1 AS indentation_level, year,
       CAST(sum(amt) AS DOUBLE) AS value
FROM fx_base GROUP BY document_id, statement_type, section_no, raw_label, year
UNION ALL
SELECT document_id, statement_type, section_no, concat('Total section ', CAST(section_no AS STRING)) AS raw_label,
       true AS is_subtotal, 0 AS indentation_level, year,
       CAST(sum(amt) * CASE WHEN (document_id + section_no) % 7 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS value
FROM fx_base GROUP BY document_id, statement_type, section_no, year""", ("fx_base",)),
    "fx_base": ("""
SELECT o.o_custkey AS document_id,
       CASE p.p_type WHEN 'ECONOMY' THEN 'balance_sheet' WHEN 'SMALL' THEN 'balance_sheet'
                     WHEN 'MEDIUM' THEN 'income_statement' WHEN 'LARGE' THEN 'income_statement'
                     WHEN 'PROMO' THEN 'cash_flow' ELSE 'equity_statement' END AS statement_type,
       p.p_size % 5 AS section_no, p.p_name AS raw_label,
       CAST(year(l.l_shipdate) AS STRING) AS year,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amt
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""", ()),
    "fx_rows": ("""
SELECT document_id, statement_type, section_no, raw_label, is_subtotal, indentation_level,
       CAST(row_number() OVER (PARTITION BY document_id
            ORDER BY statement_type, section_no, is_subtotal, raw_label) AS INT) AS extraction_id
FROM (SELECT DISTINCT document_id, statement_type, section_no, raw_label, is_subtotal, indentation_level FROM fx_values) t""",
                ("fx_values",)),
    "fx_row_values": ("""
SELECT r.*, v.year, v.value FROM fx_rows r JOIN fx_values v
  ON r.document_id = v.document_id AND r.statement_type = v.statement_type AND r.section_no = v.section_no
 AND r.raw_label = v.raw_label AND r.is_subtotal = v.is_subtotal""", ("fx_rows", "fx_values")),
    "fx_pages": (f"""
SELECT document_id, CAST(n + 1 AS INT) AS page_number,
       concat(CASE (document_id + n) % 9
                WHEN 0 THEN 'Consolidated Balance Sheets' WHEN 2 THEN 'Company Income Statement'
                WHEN 4 THEN 'Group Statements of Cash Flows' WHEN 6 THEN 'Statement of Changes in Equity'
                WHEN 7 THEN concat('Note ', CAST(n + 1 AS STRING)) ELSE '' END,
              chr(10), substring(text, CAST(n * {PAGE_CHARS} + 1 AS BIGINT), {PAGE_CHARS})) AS text,
       CAST((document_id * 7 + n * 13) % 400 AS INT) AS drawing_count
FROM (SELECT doc_id AS document_id, text, unnest(range((greatest(length(text), 1) - 1) // {PAGE_CHARS} + 1)) AS n FROM documents) t""", ()),
    "fx_coa": (COA_SQL, ()),
    "fx_suggestions": ("""
SELECT r.document_id, r.extraction_id, k.k AS cand_rank, c.coa_id,
       CAST((r.document_id * 31 + r.extraction_id * 17 + k.k * 7) % 100 AS DOUBLE) / 100 AS score
FROM fx_rows r CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) k
JOIN fx_coa c ON c.statement = CASE r.statement_type WHEN 'balance_sheet' THEN 'Balance Sheet' WHEN 'income_statement' THEN 'P&L' END
 AND CAST(substring(c.coa_id, 4) AS INT) = (r.extraction_id * 5 + k.k) % 64 + 1""", ("fx_rows", "fx_coa")),
    "fx_answers": ("SELECT document_id, extraction_id, coa_id, score AS confidence FROM fx_suggestions WHERE cand_rank = 1",
                   ("fx_suggestions",)),
    "fx_learned": (LEARNED_SQL, ()),
    "fx_labels": (LABELS_SQL, ()),
    "fx_canonical": ("""
SELECT document_id, template_type, 'current_assets' AS canonical_field, fp AS value FROM fx_can_base
UNION ALL SELECT document_id, template_type, 'non_current_assets', tp - fp FROM fx_can_base WHERE document_id % 11 <> 0
UNION ALL SELECT document_id, template_type, 'total_assets', CASE WHEN document_id % 5 = 0 THEN tp * 2 ELSE tp END FROM fx_can_base
UNION ALL SELECT document_id, template_type, 'total_liabilities', fp FROM fx_can_base
UNION ALL SELECT document_id, template_type, 'total_equity', tp - fp FROM fx_can_base
UNION ALL SELECT document_id, template_type, 'partners_capital', tp - fp FROM fx_can_base WHERE template_type = 'T6'
UNION ALL SELECT document_id, template_type, 'total_income', tp FROM fx_can_base
UNION ALL SELECT document_id, template_type, 'total_expenses', fp FROM fx_can_base
UNION ALL SELECT document_id, template_type, 'profit_before_tax', tp - fp FROM fx_can_base
UNION ALL SELECT document_id, template_type, 'cash_end', NULL FROM fx_can_base WHERE document_id % 2 = 0""", ("fx_can_base",)),
    "fx_can_base": ("""
SELECT c.c_custkey AS document_id, concat('T', CAST(1 + c.c_nationkey % 8 AS STRING)) AS template_type,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS tp,
       CAST(sum(CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS fp
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_nationkey""", ()),
    "fx_usage": (USAGE_SQL, ()),
    "fx_decisions": (DECISIONS_SQL, ()),
}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """`body` preceded by the named derivations, those they build on, and further named statements."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in ORACLE_CTES[name][1]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    # Each derivation is worked out once, and the whole result before any limit around it: DuckDB otherwise repeats a
    # derivation that several others use, or plans its joins for the few rows of a limit.
    parts = [*((n, ORACLE_CTES[n][0]) for n in ordered), *(extra or {}).items(), ("checked", body)]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in parts) + "\nSELECT * FROM checked"
