import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
FAST = ["b01_page_stats", "b05_detect_statements", "b10_expand_continuation", "c07_stamp_ids", "d02_dictionary_lookup", "d04_build_statement_tree", "v_run_validations",
        "d09_score_confidence", "e03_learned_lookup", "e06_candidates", "e08_route", "e10_aggregate_mappings", "e14_balance_identity", "e15_imbalance_contributors",
        "e19_crossfoot_given", "e22_format_spread", "f03_threshold_balance", "f09_republish_values", "f10_usage_rollup", "f16_spread_tree", "e23_resolve_rows",
        "g01_ingest_pages", "g02_usage_sessions", "g03_apply_decisions", "a02_parse_row_payloads", "a09_export_raw_json"]


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, con, name):
    text, _, good = compare.compare(spark, con, name, SF)
    assert good, text


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
