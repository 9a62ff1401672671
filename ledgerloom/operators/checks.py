"""Accounting checks on canonical values, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from .canonical import total_of


def _fields() -> list[str]:
    used = ["total_assets", "total_liabilities", "total_equity", "profit_before_tax", "total_income", "total_expenses", "net_income",
            "income_tax_expense", "total_comprehensive_income", "other_comprehensive_income", "cash_end", *R.CASH_COMPONENTS,
            "total_revenue", *R.REVENUE_COMPONENTS, *R.EXPENSE_COMPONENTS, "current_assets", "non_current_assets", "closing_equity",
            "opening_equity", "dividends_paid", "weighted_avg_shares", "eps_basic", "partners_capital"]
    return list(dict.fromkeys(used))


def _sides() -> dict[str, tuple[Column, Column]]:
    """(left, right) of each identity; a side is null when its check is to be skipped."""
    c = F.col

    def present_sum(names: list[str]) -> Column:
        some = F.coalesce(*[c(n) for n in names]).isNotNull()
        return F.when(some, total_of([F.coalesce(c(n), F.lit(0.0)) for n in names]))

    income = F.coalesce(c("total_comprehensive_income"), c("net_income"), F.lit(0.0))
    eps = F.when(c("template_type").isin(R.EPS_TEMPLATES) & (c("weighted_avg_shares") != 0), c("net_income") / c("weighted_avg_shares"))
    return {
        "V01": (c("total_assets"), c("total_liabilities") + c("total_equity")),
        "V02": (c("profit_before_tax"), c("total_income") - c("total_expenses")),
        "V03": (c("net_income"), c("profit_before_tax") - c("income_tax_expense")),
        "V04": (c("total_comprehensive_income"), c("net_income") + c("other_comprehensive_income")),
        "V05": (c("cash_end"), present_sum(R.CASH_COMPONENTS)),
        "V06": (c("total_revenue"), present_sum(R.REVENUE_COMPONENTS)),
        "V07": (c("total_expenses"), present_sum(R.EXPENSE_COMPONENTS)),
        "V08": (c("total_assets"), c("current_assets") + c("non_current_assets")),
        "V09": (c("closing_equity"), c("opening_equity") + income - F.abs(F.coalesce("dividends_paid", F.lit(0.0)))),
        "V10": (c("eps_basic"), eps),
        "V11": (F.when(c("template_type") == "T6", c("partners_capital")), c("total_equity")),
        "V12": (F.lit(None).cast("double"), F.lit(None).cast("double")),
    }


def run_validations(canonical: DataFrame) -> DataFrame:
    """13 checks per document from (document_id, template_type, canonical_field, value), one value per field.

    One aggregation turns the fields into columns; the checks are expressions over them.
    """
    wide = canonical.groupBy("document_id", "template_type").agg(
        *[F.max(F.when(F.col("canonical_field") == f, F.col("value"))).alias(f) for f in _fields()])

    def entry(check: str, lhs: Column, rhs: Column, status: Column, diff: Column) -> Column:
        name, formula, tol = R.VALIDATION_CHECKS[check]
        return F.struct(F.lit(check).alias("check_id"), F.lit(name).alias("name"), F.lit(formula).alias("formula"), F.lit(tol).alias("tolerance"),
                        status.alias("status"), lhs.cast("double").alias("lhs"), rhs.cast("double").alias("rhs"), F.round(diff, 6).alias("diff_pct"))

    entries = []
    for check, (lhs, rhs) in _sides().items():
        both = lhs.isNotNull() & rhs.isNotNull()
        diff = F.abs(lhs - rhs) / F.greatest(F.abs(lhs), F.abs(rhs), F.lit(1.0))
        tol = R.VALIDATION_CHECKS[check][2]
        status = F.when(both & (diff <= tol), "passed").when(both, "failed").otherwise("skipped")
        entries.append(entry(check, F.when(both, lhs), F.when(both, rhs), status, F.when(both, diff)))
    present = total_of([F.coalesce(*[F.col(f) for f in fields]).isNotNull().cast("int") for fields in R.STATEMENT_INDICATORS.values()])
    need = len(R.STATEMENT_INDICATORS)
    entries.append(entry("V13", present, F.lit(need), F.when(present == need, "passed").otherwise("failed"), (F.lit(need) - present) / need * 100))
    return wide.select("document_id", "template_type", F.inline(F.array(*entries)))


def validation_summary(checks: DataFrame) -> DataFrame:
    """Check → status of each document as one map, with counts."""
    return checks.groupBy("document_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("check_id", "status")))).alias("statuses"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")])


def health_score(documents: DataFrame, checks: DataFrame) -> DataFrame:
    """Share of passed checks in percent: `api_health` counts 0 when all are skipped, `list_health` 100."""
    n = checks.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == "passed").alias("_p"),
                                          F.count_if(F.col("status") == "skipped").alias("_s"))
    j = documents.select("document_id").join(n, "document_id", "left")
    ran = F.col("_n") - F.col("_s")
    ratio = F.round(F.col("_p") / F.greatest(ran, F.lit(1)) * 100).cast("int")
    return j.select("document_id", F.when(F.coalesce("_n", F.lit(0)) == 0, 100).otherwise(ratio).alias("api_health"),
                    F.when(F.coalesce(ran, F.lit(0)) == 0, 100).otherwise(ratio).alias("list_health"))


def yoy_check(values: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Comparatives of a filing against the same company's filing of the year before.

    `values`: company, canonical_field, fiscal_year, year, value. A filing's value for the year before its
    own is compared with that year's own filing.
    """
    own = values.filter(F.col("year") == F.col("fiscal_year")).select("company", "canonical_field", "year", F.col("value").alias("reported"))
    prior = values.filter(F.col("year") == F.col("fiscal_year") - 1).select("company", "canonical_field", "fiscal_year", "year",
                                                                            F.col("value").alias("comparative"))
    j = prior.join(own, ["company", "canonical_field", "year"], "left")
    diff = F.abs(F.col("comparative") - F.col("reported")) / F.greatest(F.abs("comparative"), F.abs("reported"), F.lit(1.0))
    both = F.col("comparative").isNotNull() & F.col("reported").isNotNull()
    return j.withColumn("diff_pct", F.round(F.when(both, diff), 6)).withColumn(
        "status", F.when(~both, "skipped").when(diff <= tolerance, "passed").otherwise("failed"))
