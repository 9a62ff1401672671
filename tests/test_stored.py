"""Stages on rows that are stored by document: the same results, and documents stay where they are."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_prepare import write

from ledgerloom.operators import coa as A
from ledgerloom.operators import learning as L
from ledgerloom.operators import ordered as O
from ledgerloom.operators import reconcile as Q
from ledgerloom.plans.adapters import tables
from ledgerloom.plans.queries_coa import crossfooted, grouped, recon_rows, routed, signed


@pytest.fixture
def few_broadcasts(spark):
    """Only tables of some kB are broadcast, so that 20,000 parts are not."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def more_parts(spark, folder, parts=20_000):
    rows = spark.range(parts).select(F.col("id").cast("int").alias("p_partkey"), F.concat(F.lit("part "), F.col("id") % 9).alias("p_name"),
                                     F.element_at(F.array(*map(F.lit, ["ECONOMY", "LARGE", "PROMO"])), (F.col("id") % 3 + 1).cast("int")).alias("p_type"),
                                     (F.col("id") % 6).cast("int").alias("p_size"), F.concat(F.lit("Brand"), F.col("id") % 5).alias("p_brand"))
    rows.write.mode("overwrite").parquet(f"{folder}/part.parquet")


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_routed_and_signed_rows_meet_a_small_chart_where_they_are(spark, tmp_path, capsys, few_broadcasts):
    write(spark, tmp_path)
    more_parts(spark, tmp_path)
    t = tables(spark, str(tmp_path))
    routed = A.route(t.rows, t.answers)
    assert "Exchange hashpartitioning" not in plan_of(routed, capsys)
    signed = A.aggregate_mappings(A.signed_values(t.stored(routed), t.row_values, t.coa))
    assert "Exchange hashpartitioning" not in plan_of(signed, capsys)
    assert signed.count() > 0 and routed.count() == t.rows.count()


def test_learned_mappings_meet_rows_where_they_are(spark, tmp_path, capsys, few_broadcasts):
    write(spark, tmp_path)
    more_parts(spark, tmp_path)
    t = tables(spark, str(tmp_path))
    hits = L.learned_lookup(t.rows.withColumn("template_type", F.lit("T1")), t.learned)
    assert "Exchange hashpartitioning" not in plan_of(hits, capsys)
    assert {r.tier for r in hits.select("tier").distinct().collect()} <= {1, 2, 3} and hits.count() > 0


def test_subtotals_of_stored_rows_are_grouped_without_exchange(spark, tmp_path, capsys):
    write(spark, tmp_path)
    t = tables(spark, str(tmp_path))
    kept = []
    comps, subs = Q.group_subtotals(recon_rows(t), t.row_values, keep=lambda df: kept.append(plan_of(df, capsys)) or t.stored(df))
    assert kept and all("Exchange hashpartitioning" not in plan for plan in kept)
    plain_comps, plain_subs = Q.group_subtotals(recon_rows(t), t.row_values)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(comps) == rows(plain_comps) and rows(subs) == rows(plain_subs) and comps.count() > 0


def test_crossfoot_years_are_written_once(spark, tmp_path, monkeypatch):
    write(spark, tmp_path)
    t = tables(spark, str(tmp_path))
    written = []
    monkeypatch.setattr(Q, "materialise", lambda df, *a, _real=Q.materialise: written.append(df.columns) or _real(df, *a))
    years, _ = crossfooted(t)
    assert years.count() > 0 and not any("computed" in columns for columns in written)


def test_flat_list_joins_its_components_once(spark, tmp_path, capsys):
    write(spark, tmp_path)
    t = tables(spark, str(tmp_path))
    years, report = crossfooted(t)
    kept = []
    flat = Q.recon_flat(grouped(t)[0], report, years, t.rows, t.row_values, A.outcomes(routed(t)), t.coa, Q.sign_flip(t.row_values, signed(t)), lambda df: kept.append(df) or t.stored(df))
    assert len(kept) == 1 and "coa_name" in kept[0].columns and plan_of(flat, capsys).count("Join") <= 2
    listed = flat.filter("component_id IS NOT NULL").groupBy("subtotal_id", "document_id").agg(F.count_if(F.col("status") != "mapped").alias("n"))
    tops = flat.filter("component_id IS NULL").select("document_id", "subtotal_id", "n_missing")
    assert tops.join(listed, ["document_id", "subtotal_id"], "left").filter("n_missing <> coalesce(n, 0)").count() == 0 and tops.count() == report.count() > 0


def test_stored_stages_count_for_more_than_their_files(spark, tmp_path):
    write(spark, tmp_path)
    t = tables(spark, str(tmp_path))
    stage = t.stored(spark.range(50_000).select((F.col("id") % 9).alias("document_id"), F.lit("one label").alias("raw_label")))
    files = sum(f.stat().st_size for f in map(Path, (x.removeprefix("file:") for x in stage.inputFiles())))
    assert int(str(stage._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 3 * files


def test_running_without_chunks_equals_chunks(spark):
    df = spark.sql("SELECT CASE WHEN id % 5 = 0 THEN NULL ELSE id % 5 END AS doc, CAST(id AS INT) AS ord, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 11 END AS v FROM range(300)")
    outs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    rows = lambda d: sorted(map(str, d.collect()))
    whole = O.running(df, ["doc"], "ord", outs, chunk_rows=None)
    assert rows(whole) == rows(O.running(df, ["doc"], "ord", outs, chunk_rows=16)) and whole.columns == ["doc", "ord", "v", "s", "m"]
