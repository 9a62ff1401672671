"""Canonical mapping: dictionary lookup, disambiguation, statement trees, confidence, review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..session import materialise
from .ordered import running, top_k
from .textjoin import contains_join

SUBSTRING_PENALTY = 0.15
SUBSTRING_FLOOR = 0.4
TREE_TOLERANCE = 0.005


def dictionary_lookup(rows: DataFrame, rules: DataFrame, label: str = "normalized_label") -> DataFrame:
    """Field of each row's label: own template, then any template, then substring either way; first rule wins.

    The lookup runs once per distinct (template, label). Substring candidates come from an equi-join on
    character grams and only for labels without an exact rule.
    """
    labels = rows.select("template_type", label).distinct()
    r = rules.select("rule_ord", F.col("template_type").alias("rule_template"), "rule_label", "canonical_field", "rule_confidence")
    fits = F.col("rule_template").isNull() | (F.col("rule_template") == F.col("template_type"))
    tier = F.when(F.col("rule_template").isNull(), 2).otherwise(1)
    best = F.struct("canonical_field", F.col("rule_confidence").alias("confidence"), tier.alias("tier"))
    exact = (labels.join(r, (labels[label] == r["rule_label"]) & fits).groupBy("template_type", label)
             .agg(F.min_by(best, F.struct(tier.alias("a"), F.col("rule_ord"))).alias("b")).select("template_type", label, "b.*"))
    # Written once: both substring joins read them several times.
    rest, r = materialise(labels.join(exact, ["template_type", label], "left_anti")), materialise(r)
    either = contains_join(rest, label, r, "rule_label").unionByName(contains_join(r, "rule_label", rest, label)).filter(
        fits & (F.col(label) != F.col("rule_label")))
    partial = F.struct("canonical_field", F.greatest(F.col("rule_confidence") - SUBSTRING_PENALTY, F.lit(SUBSTRING_FLOOR)).alias("confidence"),
                       F.lit(3).alias("tier"))
    loose = either.groupBy("template_type", label).agg(F.min_by(partial, "rule_ord").alias("b")).select("template_type", label, "b.*")
    found = exact.unionByName(loose)
    return rows.join(found, ["template_type", label], "left").withColumns({
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "mapping_method": F.when(F.col("canonical_field").isNotNull(), "dictionary").otherwise("model")})


def disambiguate(rows: DataFrame, label: str = "normalized_label") -> DataFrame:
    """Replace the field of labels whose meaning depends on the statement; confidence never rises."""
    investing = F.exists("section_path", lambda s: F.lower(s).contains("investing"))

    def pick(index: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for rule in reversed(R.DISAMBIGUATION_RULES):
            cond = (F.col(label) == rule[0]) & (F.col("statement_type") == rule[1])
            out = F.when(cond & investing if rule[2] else cond, rule[index]).otherwise(out)
        return F.when(F.col("canonical_field").isNotNull(), out)

    d = rows.withColumns({"_field": pick(3, "string"), "_conf": pick(4, "double"), "_flag": pick(5, "boolean")})
    return d.withColumns({"canonical_field": F.coalesce("_field", F.col("canonical_field")),
                          "confidence": F.least("confidence", F.coalesce("_conf", F.col("confidence"))),
                          "flag_for_review": F.coalesce("_flag", F.lit(False))}).drop("_field", "_conf", "_flag")


def tree_groups(rows: DataFrame, ord_col: str = "extraction_id") -> DataFrame:
    """Adds group_no, the number of subtotals before the row in its statement."""
    return running(rows, ["document_id", "statement_type"], ord_col, {"group_no": ("sum", F.col("is_subtotal").cast("int"))})


def build_statement_tree(rows: DataFrame, ord_col: str = "extraction_id") -> DataFrame:
    """Subtotals with the sum of the rows since the previous subtotal, and whether it agrees within 0.5 %.

    `rows` carries one `value` per row. The group without a subtotal holds the rows left at the top level.
    """
    g = tree_groups(rows, ord_col)
    leaf, sub = ~F.col("is_subtotal"), F.col("is_subtotal")
    out = g.groupBy("document_id", "statement_type", "group_no").agg(
        F.max(F.when(sub, F.col(ord_col))).alias("subtotal_id"), F.max(F.when(sub, F.col("raw_label"))).alias("raw_label"),
        F.max(F.when(sub, F.col("value"))).alias("value"), F.count_if(leaf).alias("n_children"),
        F.sum(F.when(leaf, F.coalesce("value", F.lit(0.0)))).alias("children_sum"))
    ok = (F.abs(F.col("value") - F.col("children_sum")) <= F.abs("value") * TREE_TOLERANCE) | (F.col("value") == 0)
    return out.withColumn("sum_valid", F.when(F.col("subtotal_id").isNotNull() & F.col("value").isNotNull() & (F.col("n_children") > 0), ok))


def infer_subtotals(rows: DataFrame, canonical_fields: DataFrame, fields: list[str]) -> DataFrame:
    """Values of absent subtotals that at least two top-level rows of the statement roll up to."""
    parents = canonical_fields.filter(F.col("parent_field").isin(fields)).select("canonical_field", "parent_field")
    present = rows.filter(F.col("is_subtotal") & F.col("canonical_field").isin(fields)).select(
        "document_id", F.col("canonical_field").alias("parent_field")).distinct()
    kids = rows.filter(~F.col("is_subtotal") & F.col("value").isNotNull()).join(parents, "canonical_field")
    return (kids.groupBy("document_id", "parent_field").agg(F.count(F.lit(1)).alias("n_children"), F.sum("value").alias("inferred_value"))
            .filter("n_children >= 2").join(present, ["document_id", "parent_field"], "left_anti"))


def primary_year(row_values: DataFrame, mode: str = "latest") -> DataFrame:
    """Year a document is judged by: its latest four-digit key, or (mode 'frequent') the most frequent, ties to the smallest."""
    v = row_values.filter(F.col("year").rlike(r"^\d{4}$"))
    if mode == "latest":
        return v.groupBy("document_id").agg(F.max("year").alias("primary_year"))
    n = v.groupBy("document_id", "year").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("document_id").agg(F.min_by("year", F.struct(-F.col("n"), F.col("year"))).alias("primary_year"))


def primary_values(row_values: DataFrame, years: DataFrame, keys: list[str]) -> DataFrame:
    """One row per `keys` with its value in the document's primary year, null when it has none."""
    return row_values.join(years, "document_id").groupBy(*keys).agg(
        F.max(F.when(F.col("year") == F.col("primary_year"), F.col("value"))).alias("value"))


def canonical_map(rows: DataFrame, ord_col: str = "extraction_id") -> DataFrame:
    """Value per field and document; the last row wins even when its value is null."""
    return rows.filter("canonical_field IS NOT NULL").groupBy("document_id", "canonical_field").agg(F.max_by("value", ord_col).alias("value"))


def score_confidence(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Composite confidence and review status.

    `rows`: document_id, canonical_field, confidence (of the dictionary), ocr. A failed check counts against
    every row whose field name occurs in the check's formula text.
    """
    failed = checks.filter("status = 'failed'").groupBy("document_id").agg(F.collect_list("formula").alias("_failed"))
    j = rows.join(failed, "document_id", "left")
    mapped = F.col("canonical_field").isNotNull()
    hit = F.coalesce(F.exists("_failed", lambda f: f.contains(F.col("canonical_field"))), F.lit(False))
    formula = F.when(~mapped, 0.80).when(hit, 0.30).otherwise(1.0)
    score = (F.col("confidence") * 0.50 + F.when(mapped, 0.90).otherwise(0.50) * 0.20 + formula * 0.20 + F.lit(0.80 * 0.10)
             - F.when(F.col("ocr"), 0.05).otherwise(0.0))
    score = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6)
    return j.withColumn("score", score).drop("_failed").withColumn(
        "review_status", F.when(F.col("score") >= R.AUTO_APPROVE, "auto_approved").otherwise("needs_review"))


def unmatched(rows: DataFrame, cap: int | None = None, ord_col: str = "extraction_id") -> DataFrame:
    """Rows no rule matched, with a score of at most 0.35; all of them, or the first `cap` per document."""
    rest = rows.filter((F.col("mapping_method") == "model") & (F.col("score") <= 0.35))
    return rest if cap is None else top_k(rest, ["document_id"], [F.col(ord_col)], cap).drop("rank_no")


def apply_fallback(rows: DataFrame, answers: DataFrame, canonical_fields: DataFrame) -> DataFrame:
    """Unmatched rows take the field of an answer table (document_id, extraction_id, answer_field, answer_confidence).

    Answers outside the fields of the row's template are ignored.
    """
    allowed = canonical_fields.select(F.col("canonical_field").alias("answer_field"), "supported_templates")
    a = answers.join(allowed, "answer_field")
    j = rows.join(a, ["document_id", "extraction_id"], "left")
    use = (F.col("canonical_field").isNull() & F.col("answer_field").isNotNull()
           & F.array_contains("supported_templates", F.col("template_type")))
    score = F.round(F.least(F.col("answer_confidence") * 0.5 + 0.18 + 0.16 + 0.08, F.lit(1.0)), 6)
    return j.withColumn("_use", F.coalesce(use, F.lit(False))).withColumns({
        "canonical_field": F.when(F.col("_use"), F.col("answer_field")).otherwise(F.col("canonical_field")),
        "score": F.when(F.col("_use"), score).otherwise(F.col("score"))}).withColumn(
        "review_status", F.when(F.col("_use"), F.when(F.col("score") >= R.AUTO_APPROVE, "auto_approved").otherwise("needs_review"))
        .otherwise(F.col("review_status"))).select(*rows.columns)


def apply_overrides(rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after review, audit). Decisions: row_id, new_field, new_value, reviewer, reason, decided_at, decision_id.

    A decision needs a field or a value; the latest one per row counts. The value is audited, not stored.
    """
    valid = decisions.filter(F.col("new_field").isNotNull() | F.col("new_value").isNotNull())
    last = valid.groupBy("row_id").agg(
        F.max_by(F.struct("new_field"), F.struct("decided_at", "decision_id")).alias("d")).select("row_id", F.col("d.new_field").alias("_field"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    after = rows.join(last, "row_id", "left").withColumns({
        "canonical_field": F.coalesce("_field", F.col("canonical_field")),
        "review_status": F.when(hit, "reviewed").otherwise(F.col("review_status")),
        "mapping_method": F.when(hit, "override").otherwise(F.col("mapping_method"))}).select(*rows.columns)
    audit = valid.join(rows.select("row_id", F.col("canonical_field").alias("old_field"), F.col("value").alias("old_value")), "row_id")
    return after, audit


def bulk_approve(rows: DataFrame, threshold: float = R.AUTO_APPROVE, compat: bool = False) -> DataFrame:
    """Approve rows in review at or above the threshold; compat=True approves all of them."""
    cond = F.col("review_status") == "needs_review"
    if not compat:
        cond = cond & (F.col("score") >= threshold)
    return rows.withColumn("review_status", F.when(cond, "auto_approved").otherwise(F.col("review_status")))


def ontology_gap(rules: DataFrame, canonical_fields: DataFrame) -> DataFrame:
    """Fields rules map to that the field table does not define."""
    return rules.groupBy("canonical_field").agg(F.count(F.lit(1)).alias("n_rules")).join(canonical_fields, "canonical_field", "left_anti")


def total_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
