"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.

Each query runs to the end into a sink that discards its rows. The given tables are one file of one row group each,
which a single task has to read; a table of any size comes as many files. `layout` is the time to deal them out into two
files for each core, and counts. The written stages (line items, classified
pages, routed rows) are timed on their own as `prepare`, because every query of a session shares them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

HEADLINE = ["b01_page_stats", "b05_detect_statements", "b10_expand_continuation", "b18_score_templates", "a02_parse_row_payloads", "c06_dedupe_rows", "c07_stamp_ids", "d02_dictionary_lookup",
            "d04_build_statement_tree", "v_run_validations", "d09_score_confidence", "e03_learned_lookup", "e06_candidates", "e08_route", "e10_aggregate_mappings", "e14_balance_identity",
            "e15_imbalance_contributors", "e17_group_subtotals", "e19_crossfoot", "e22_format_spread", "f03_threshold_coverage", "f03_threshold_balance", "f06_unmapped_analysis",
            "f10_usage_rollup", "f12_document_library", "f16_spread_tree", "f33_statement_sheet", "f09_republish_values", "e23_resolve_rows", "a09_export_raw_json"]


def dealt_out(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The same tables in several files each."""
    target = tempfile.mkdtemp(prefix="bench-")
    for table in Path(sf_dir).glob("*.parquet"):
        spark.read.parquet(str(table)).repartition(files).write.parquet(f"{target}/{table.name}")
    return target


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from ledgerloom.plans import catalog, queries_coa, queries_pages
    from ledgerloom.plans.adapters import tables

    times: dict[str, float] = {}
    start, scale = time.time(), sf_dir.rsplit("sf", 1)[-1]
    sf_dir = dealt_out(spark, sf_dir, 2 * int(cpus))
    times["layout"] = round(time.time() - start, 3)
    start = time.time()
    t = tables(spark, sf_dir)
    for stage in (lambda: t.row_values, lambda: queries_pages.sectioned(t), lambda: queries_coa.routed(t), lambda: queries_coa.signed(t)):
        stage()
    times["prepare"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
