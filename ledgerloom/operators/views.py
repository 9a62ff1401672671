"""Read views over the tables: lists, trees, review screens and report sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import exprs as X
from .ordered import in_documents, top_k

ROW = ["document_id", "extraction_id"]
LOW_CONFIDENCE = 0.75
REVIEW_BELOW = 0.80


def fy12(row_values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Values of the two latest years of each `keys`, by the first 19dd or 20dd of the year key; nulls keep their rank."""
    newest = F.struct(X.header_year("year").alias("n"), F.col("year").alias("y"), F.col(value).alias("v"))
    # A key has a handful of years, so their list is short.
    g = row_values.groupBy(*keys).agg(F.sort_array(F.collect_list(newest), asc=False).alias("_y"))
    pick = lambda k: F.try_element_at("_y", F.lit(k))["v"]
    return g.select(*keys, pick(1).alias("fy1"), pick(2).alias("fy2"))


def document_library(documents: DataFrame, rows: DataFrame, outcomes: DataFrame, heads: DataFrame, balance: DataFrame, runs: DataFrame | None = None, usage: DataFrame | None = None) -> DataFrame:
    """Documents with mapped and mappable rows, flagged lines, health, display status and cost, newest first.

    `runs` holds one row per filename, its latest run with run_status: a run that is not done decides the display
    status. `usage` holds cost_usd per document.
    """
    o = outcomes.groupBy("document_id").agg(F.count_if(F.col("status") == "mapped").alias("mapped_rows"), F.count_if(F.col("status") == "unmapped").alias("unmapped_count"))
    m = rows.groupBy("document_id").agg(F.count_if(F.col("statement_type").isin("balance_sheet", "income_statement")).alias("mappable_rows"))
    low = heads.groupBy("document_id").agg(F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_conf"))
    b = balance.filter("headline").select("document_id", F.col("is_balanced").alias("balanced"))
    j = documents
    for part in (o, m, low, b):
        j = j.join(part, "document_id", "left")
    j = j.join(runs.select("filename", "run_status"), "filename", "left") if runs is not None else j.withColumn("run_status", F.lit(None).cast("string"))
    j = j.join(usage.select("document_id", "cost_usd"), "document_id", "left") if usage is not None else j.withColumn("cost_usd", F.lit(None).cast("double"))
    j = j.fillna(0, ["mapped_rows", "unmapped_count", "mappable_rows", "low_conf"])
    ratio = F.when(F.col("mappable_rows") > 0, F.col("mapped_rows") / F.col("mappable_rows")).otherwise(0.0)
    return j.withColumns({
        "flagged": F.col("low_conf") + F.col("unmapped_count"),
        "health": F.round(F.when(F.coalesce("balanced", F.lit(False)), 0.5).otherwise(0.0) + 0.5 * ratio, 6),
        "spread_status": F.when(F.col("unmapped_count") > 0, "has_unmapped").otherwise("spread_complete")}).withColumn("ui_status", ui_status()).orderBy(F.desc("created_at"), "document_id")


def ui_status(run: str = "run_status", spread: str = "spread_status") -> Column:
    r = F.coalesce(F.col(run), F.lit(""))
    return F.when(r.isin("error", "processing"), r).when(~r.isin("", "done"), "queued").when(F.col(spread) == "spread_complete", "complete").otherwise("has_unmapped")


def list_documents(documents: DataFrame, filters: dict[str, str] | None = None, page: int = 1, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one page of the filtered documents, newest first; total count)."""
    d = documents
    for c, v in (filters or {}).items():
        d = d.filter(F.col(c) == v)
    return d.orderBy(F.desc("created_at"), "document_id").offset((page - 1) * limit).limit(limit), d.agg(F.count(F.lit(1)).alias("total"))


def document_counts(documents: DataFrame, rows: DataFrame, mapped: DataFrame) -> DataFrame:
    a = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("extracted"))
    b = mapped.groupBy("document_id").agg(F.count(F.lit(1)).alias("mapped"), F.count_if(F.col("review_status") == "needs_review").alias("needs_review"))
    return documents.select("document_id").join(a, "document_id", "left").join(b, "document_id", "left").fillna(0)


def run_status(runs: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Status, error and, when done, the counts of each run."""
    done = F.col("run_status") == "done"
    j = runs.join(counts, key, "left")
    return j.select(*runs.columns, *[F.when(done, F.coalesce(c, F.lit(0))).alias(c) for c in counts.columns if c != key])


def joined_keys(sources: DataFrame, longest: int) -> DataFrame:
    """(document_id, coa_id, _key): the words of a line's source labels in row order, of lines whose labels are short enough.

    `longest` is the length of the longest key to compare with: longer ones are never built.
    """
    word = X.label_key("raw_label")
    named = sources.select("document_id", "coa_id", "extraction_id", word.alias("_word")).filter("_word <> ''")
    short = named.groupBy("document_id", "coa_id").agg(F.sum(F.length("_word") + 1).alias("_size")).filter(F.col("_size") <= longest + 1)
    text = F.expr("listagg(_word, ' ') WITHIN GROUP (ORDER BY extraction_id)")
    return named.join(short, ["document_id", "coa_id"], "left_semi").groupBy("document_id", "coa_id").agg(text.alias("_key"))


def spread_tree(heads: DataFrame, aggregated: DataFrame, coa: DataFrame, sources: DataFrame, row_values: DataFrame, recon: DataFrame | None = None) -> DataFrame:
    """The spread as rows: a node per chart line (leaf_id null) and a leaf per source row, in tree order.

    `sources`: document_id, coa_id, extraction_id, raw_label, and page and note_ref where there are any. Sections are
    ordered balance sheet first, then by category. Several mappings of a line (`heads` and `aggregated` then have
    mapping_id) make one node: each gives its own two latest years, which are added; a manual one makes the node manual.
    `recon` (document_id, subtotal_id, raw_label, passed, has_unmapped) flags the node whose joined source labels have
    the words of a subtotal's label: whether that foots, and whether a component of it is not mapped.
    """
    one = [c for c in ("mapping_id",) if c in heads.columns and c in aggregated.columns]
    chart = coa.select("coa_id", "line_item_name", "statement", F.coalesce("broad_category", F.lit("Other")).alias("category"))
    order = F.when(F.col("statement") == "P&L", 2).otherwise(1)
    years = fy12(aggregated, ["document_id", "coa_id", *one]).groupBy("document_id", "coa_id").agg(F.sum("fy1").alias("fy1"), F.sum("fy2").alias("fy2"))
    nodes = (heads.groupBy("document_id", "coa_id").agg(
        F.sum("aggregated_from").alias("aggregated_from"), F.min_by("confidence", "first_row").alias("confidence"),
        F.coalesce(F.max(F.when(F.col("mapping_source") == "manual", "manual")), F.min_by("mapping_source", "first_row")).alias("source"))
        .join(years, ["document_id", "coa_id"], "left").join(chart, "coa_id"))
    flags = {"reconciles": F.lit(None).cast("boolean"), "missing_leaf": F.lit(None).cast("boolean")}
    if recon is not None:
        r = recon.select("document_id", "subtotal_id", X.label_key("raw_label").alias("_key"), "passed", "has_unmapped").filter("_key <> ''")
        longest = r.agg(F.coalesce(F.max(F.length("_key")), F.lit(0))).first()[0]
        r = r.groupBy("document_id", "_key").agg(F.max_by(F.struct("passed", "has_unmapped"), "subtotal_id").alias("_r"))
        nodes = nodes.join(joined_keys(sources, longest).join(r, ["document_id", "_key"]).drop("_key"), ["document_id", "coa_id"], "left")
        flags = {"reconciles": F.col("_r.passed"), "missing_leaf": F.col("_r.has_unmapped")}
    cols = ["document_id", order.alias("section_order"), "statement", "category", "coa_id", "line_item_name"]
    top = nodes.select(*cols, F.lit(None).cast("int").alias("leaf_id"), F.lit(None).cast("string").alias("leaf_label"), "fy1", "fy2", "confidence", "source", "aggregated_from",
                       *[f.alias(n) for n, f in flags.items()], F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("note_ref"))
    own = {n: (F.col(n) if n in sources.columns else F.lit(None)).cast(kind) for n, kind in (("page", "int"), ("note_ref", "string"))}
    leaf = sources.join(fy12(row_values, ROW), ROW, "left").join(chart, "coa_id").select(
        *cols, F.col("extraction_id").alias("leaf_id"), F.col("raw_label").alias("leaf_label"), "fy1", "fy2", F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("aggregated_from"), *[F.lit(None).cast("boolean").alias(n) for n in flags], *[c.alias(n) for n, c in own.items()])
    return top.unionByName(leaf)


def tree_sections(tree: DataFrame) -> DataFrame:
    """Leaves and lines of a tree rolled up to its sections: counts, sums of the two years, and the lines that are flagged."""
    line = F.col("leaf_id").isNull()
    return tree.groupBy("document_id", "section_order", "statement", "category").agg(
        F.count_if(line).alias("n_lines"), F.count_if(~line).alias("n_leaves"), F.sum(F.when(line, F.col("fy1"))).alias("fy1"), F.sum(F.when(line, F.col("fy2"))).alias("fy2"),
        F.count_if(F.col("reconciles")).alias("n_reconciled"), F.count_if(~F.col("reconciles")).alias("n_failed"), F.count_if("missing_leaf").alias("n_missing_leaf"))


def workbench_rows(rows: DataFrame, mappings: DataFrame, coa: DataFrame) -> DataFrame:
    """Rows with the mapping whose id array holds them (the later mapping wins) and the chart name, else the id.

    `mappings`: document_id, mapping_id, coa_id, source_extraction_ids.
    """
    m = mappings.select("document_id", "mapping_id", "coa_id", F.explode("source_extraction_ids").alias("extraction_id"))
    m = m.groupBy(*ROW).agg(F.max_by(F.struct("mapping_id", "coa_id"), "mapping_id").alias("m")).select(*ROW, "m.*")
    j = rows.join(m, ROW, "left").join(coa.select("coa_id", "line_item_name"), "coa_id", "left")
    return j.withColumn("coa_name", F.coalesce("line_item_name", "coa_id")).drop("line_item_name")


def rows_by_document(rows: DataFrame, document_id=None, statement_type: str | None = None) -> DataFrame:
    r = rows if document_id is None else rows.filter(F.col("document_id") == document_id)
    r = r if statement_type is None else r.filter(F.col("statement_type") == statement_type)
    return in_documents(r, "extraction_id")


def mapped_rows_view(mapped: DataFrame, rows: DataFrame, review_status: str | None = None, below: float | None = None) -> DataFrame:
    m = mapped if review_status is None else mapped.filter(F.col("review_status") == review_status)
    m = m if below is None else m.filter(F.col("score") < below)
    return m.join(rows, ROW, "left")


def unmapped_view(items: DataFrame, suggestions: DataFrame, coa: DataFrame, pending_only: bool = False, k: int = 3, pages: DataFrame | None = None) -> DataFrame:
    """Items not mapped with their k best suggestions, one row per suggestion, named and defined from the chart.

    `pages` (document_id, extraction_id, page) says where an item's first source row stands; 0 where it is not known.
    """
    states = ["unmapped"] if pending_only else ["unmapped", "not_spread"]
    i = items.filter(F.col("status").isin(states)).select(*ROW, "raw_label", "statement_type", "status")
    extra = ["page"] if pages is not None else []
    if pages is not None:
        i = i.join(pages.select(*ROW, "page"), ROW, "left").withColumn("page", F.coalesce("page", F.lit(0)))
    named = coa.select("coa_id", F.col("line_item_name").alias("coa_name"), *(["definition"] if "definition" in coa.columns else []))
    s = top_k(suggestions.join(named, "coa_id", "left"), ROW, [F.desc("score"), F.col("cand_rank")], k, "suggestion_no")
    j = i.join(s.select(*ROW, "suggestion_no", *named.columns, "score"), ROW, "left")
    return in_documents(j, "status", "raw_label", *ROW, *extra, "suggestion_no")


def confidence_rows(heads: DataFrame, coa: DataFrame) -> DataFrame:
    return heads.join(coa.select("coa_id", "line_item_name", "statement"), "coa_id").transform(in_documents, "confidence", "coa_id")


def learned_applied(routed: DataFrame, learned: DataFrame) -> DataFrame:
    cols = ["learned_id", "source_document", "rationale", "times_applied"]
    return routed.filter("mapping_source = 'learned'").join(learned.select(*cols), "learned_id")


def learned_list(learned: DataFrame, template: str | None = None, statement: str | None = None, deleted: DataFrame | None = None) -> DataFrame:
    d = learned if template is None else learned.filter(F.col("template_type") == template)
    d = d if statement is None else d.filter(F.col("statement_type") == statement)
    d = d if deleted is None else d.join(deleted.select("learned_id"), "learned_id", "left_anti")
    return d.orderBy(F.desc("created_seq"))


def notes_view(notes: DataFrame, document_id=None, note_number: int | None = None) -> DataFrame:
    n = notes if document_id is None else notes.filter(F.col("document_id") == document_id)
    n = n if note_number is None else n.filter(F.col("note_number") == note_number)
    return in_documents(n, "note_number")


def override_history(audit: DataFrame, wanted: DataFrame) -> DataFrame:
    """Override records of a set of rows, in one join."""
    return audit.join(wanted.select("row_id").distinct(), "row_id", "left_semi")


def coa_view(coa: DataFrame, statement: str | None = None) -> DataFrame:
    c = coa if statement is None else coa.filter(F.col("statement") == statement)
    return c.orderBy(F.split_part("coa_id", F.lit("-"), F.lit(1)), F.split_part("coa_id", F.lit("-"), F.lit(2)).cast("int"))


def validation_view(documents: DataFrame, balance: DataFrame, recon: DataFrame) -> DataFrame:
    """Balance headline and reconciliation counts of each document."""
    b = balance.filter("headline").select("document_id", F.col("year").alias("balance_year"), "difference", "is_balanced")
    return documents.select("document_id").join(b, "document_id", "left").join(recon, "document_id", "left")


SCOPE_GROUPS = {"consolidated": ["consolidated", "group"], "standalone": ["standalone", "company"]}


def statement_view(rows: DataFrame, notes: DataFrame, row_values: DataFrame, scope: str = "both") -> DataFrame:
    """Rows of a scope with section order, whether their note exists, and the FY1 value."""
    r = rows if scope == "both" else rows.filter(F.col("statement_scope").isin(SCOPE_GROUPS[scope]))
    r = r.withColumn("note_number", X.note_number("note_ref"))
    known = notes.select("document_id", "note_number").distinct().withColumn("_n", F.lit(True))
    order = F.array_position(F.array(*map(F.lit, R.STATEMENT_TYPES)), F.col("statement_type"))
    j = r.join(known, ["document_id", "note_number"], "left").join(fy12(row_values, ROW).select(*ROW, "fy1"), ROW, "left")
    return j.withColumns({"has_note": F.coalesce("_n", F.lit(False)), "section_order": order.cast("int")}).drop("_n")


def review_view(mapped: DataFrame, row_values: DataFrame, scope: str | None = None, statement_type: str | None = None) -> DataFrame:
    """Rows in review or below 0.8 (no score counts as sure), with current and previous year values."""
    m = mapped.filter((F.col("review_status") == "needs_review") | (F.coalesce("score", F.lit(1.0)) < REVIEW_BELOW))
    m = m if scope is None else m.filter(F.col("statement_scope") == scope)
    m = m if statement_type is None else m.filter(F.col("statement_type") == statement_type)
    return m.join(fy12(row_values, ROW), ROW, "left")


def tier_filter(mapped: DataFrame, tier: str) -> DataFrame:
    """Rows of an export tier: raw, canonical (field known) or reviewed (auto-approved)."""
    cond = {"raw": F.lit(True), "canonical": F.col("canonical_field").isNotNull(), "reviewed": F.col("review_status") == "auto_approved"}[tier]
    return mapped.filter(cond)


def years_of(row_values: DataFrame) -> list[str]:
    """The year keys of the values, newest first: the columns of a sheet."""
    return sorted((r.year for r in row_values.select("year").distinct().collect() if r.year is not None), reverse=True)


def statement_sheet(rows: DataFrame, row_values: DataFrame, documents: DataFrame, years: list[str] | None = None, scores: DataFrame | None = None) -> DataFrame:
    """One row per line with a column per year and, in other currencies than USD, per year in USD; newest year first.

    Without `years` the columns are all year keys of the values. `scores` (document_id, extraction_id, confidence) adds the
    confidence, to two places.
    """
    years = years_of(row_values) if years is None else years
    usd = X.to_usd("value", "currency_code")
    cur = documents.select("document_id", "currency_code")
    v = row_values.join(cur, "document_id")
    pick = [e for y in sorted(years, reverse=True) for e in (
        F.max(F.when(F.col("year") == y, F.col("value"))).alias(y),
        F.max(F.when((F.col("year") == y) & (F.col("currency_code") != "USD"), usd)).alias(f"{y}_USD"))]
    lines = rows if scores is None else rows.join(scores.select(*ROW, F.round("confidence", 2).alias("confidence")), ROW, "left")
    return lines.join(v.groupBy(*ROW).agg(*pick), ROW, "left")


def _unpivot(counts: DataFrame, keys: list[str], name: str = "metric") -> DataFrame:
    return counts.unpivot(keys, [c for c in counts.columns if c not in keys], name, "n")


def summary_sheet(mapped: DataFrame, checks: DataFrame) -> DataFrame:
    a = mapped.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("review_status") == "auto_approved").alias("auto_approved"),
        F.count_if(F.col("review_status") == "needs_review").alias("needs_review"), F.count_if(F.col("score") >= 0.80).alias("at_least_080"))
    b = checks.groupBy("document_id").agg(F.count_if(F.col("status") == "passed").alias("checks_passed"), F.count_if(F.col("status") == "failed").alias("checks_failed"))
    return _unpivot(a.join(b, "document_id", "left"), ["document_id"])


def metadata_sheet(mapped: DataFrame) -> DataFrame:
    """Rows by mapping method and by confidence bracket."""
    s = F.col("score")
    edges = [("below_050", s < 0.5), ("050_070", (s >= 0.5) & (s < 0.7)), ("070_080", (s >= 0.7) & (s < 0.8)), ("080_092", (s >= 0.8) & (s < 0.92)), ("from_092", s >= 0.92)]
    methods = ["dictionary", "model", "override"]
    return _unpivot(mapped.groupBy("document_id").agg(*[F.count_if(F.col("mapping_method") == m).alias(f"method_{m}") for m in methods],
                                                      *[F.count_if(c).alias(f"confidence_{n}") for n, c in edges]), ["document_id"])


def validation_sheet(checks: DataFrame) -> DataFrame:
    return checks.select("document_id", "check_id", "name", "status", "lhs", "rhs", (F.round(F.col("diff_pct") * 10000) / 100).alias("diff_percent"))


def raw_sheet(rows: DataFrame, row_values: DataFrame) -> DataFrame:
    """Rows as extracted: Yes/No flags and values as JSON."""
    j = row_values.groupBy(*ROW).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value"))))).alias("values_json"))
    return rows.join(j, ROW, "left").withColumn("subtotal", F.when(F.col("is_subtotal"), "Yes").otherwise("No"))


def unmapped_sheet(items: DataFrame, suggestions: DataFrame, row_values: DataFrame, years: list[str] | None = None) -> DataFrame:
    """Unmapped rows with a column per year, their source row ids, the best suggestion and all other suggestions as text.

    An item of several source rows has them in source_extraction_ids; any other is its own.
    """
    years = years_of(row_values) if years is None else years
    s = suggestions.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "cand_rank", "coa_id"))).alias("s"))
    text = F.array_join(F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda e: F.concat(e["coa_id"], F.lit(" ("), F.format_string("%.2f", -e["neg"]), F.lit(")"))), ", ")
    s = s.select(*ROW, F.col("s")[0]["coa_id"].alias("best"), text.alias("others"))
    v = row_values.groupBy(*ROW).agg(*[F.max(F.when(F.col("year") == y, F.col("value"))).alias(y) for y in sorted(years, reverse=True)])
    ids = F.array_join("source_extraction_ids", ", ") if "source_extraction_ids" in items.columns else F.col("extraction_id").cast("string")
    waiting = items.filter("status IN ('unmapped', 'not_spread')").select(*ROW, "raw_label", "statement_type", "status", ids.alias("source_ids"))
    return waiting.join(s, ROW, "left").join(v, ROW, "left")


def status_tallies(mapped: DataFrame, checks: DataFrame, page_summary: DataFrame) -> DataFrame:
    a = mapped.agg(F.count_if(F.col("review_status") == "needs_review").alias("needs_review"), F.count_if(F.col("review_status") == "auto_approved").alias("approved"))
    b = checks.agg(F.count_if(F.col("status") == "failed").alias("errors"))
    c = page_summary.agg(F.sum(F.col("scanned") + F.col("hybrid")).alias("ocr_pages"))
    named = [_unpivot(x.withColumn("_k", F.lit(0)), ["_k"]).drop("_k") for x in (a, b, c)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def spread_header(documents: DataFrame, heads: DataFrame, balance: DataFrame, routed: DataFrame) -> DataFrame:
    m = heads.groupBy("document_id").agg(F.count(F.lit(1)).alias("mappings"))
    b = balance.filter("headline").select("document_id", "is_balanced", "difference")
    p = routed.groupBy("document_id").agg(F.count_if(F.col("status") == "unmapped").alias("pending"))
    return documents.join(m, "document_id", "left").join(b, "document_id", "left").join(p, "document_id", "left").fillna(0, ["mappings", "pending"])
