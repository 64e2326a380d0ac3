"""Physical-plan properties: pushdown, pruning, broadcast dimensions, no
cartesian products."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SF0001

Q = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_date_range_pushed_to_scan(spark):
    p = plan(Q["f2_filter_date_range"](spark, SF0001))
    assert "GreaterThanOrEqual(ts,2024-01-08" in p and "LessThan(ts,2024-01-15" in p


def test_validity_filter_pushed(spark):
    p = plan(Q["f9_clean_and_validate"](spark, SF0001))
    assert "GreaterThanOrEqual(ts,2000-01-01" in p


def test_box_and_validity_pushed_on_incident_table(spark):
    import os
    import tempfile
    from sentinela.operators import clean
    from sentinela.plans import fixtures as X
    d = os.path.join(tempfile.mkdtemp(prefix="sentinela-plan-"), "occ")
    X.occ(spark, SF0001).write.parquet(d)
    p = plan(clean.clean_and_validate(spark.read.parquet(d)))
    pushed = [line for line in p.splitlines() if "PushedFilters" in line][0]
    for f in ("GreaterThanOrEqual(latitude,-8.12)", "LessThanOrEqual(longitude,-34.85)",
              "GreaterThanOrEqual(data_ocorrencia,2000-01-01"):
        assert f in pushed


def test_scan_reads_only_needed_columns(spark):
    p = plan(Q["a1_frequency_bairro"](spark, SF0001))
    assert "ReadSchema: struct<user_id:bigint>" in p


def test_dimensions_are_broadcast(spark):
    p = plan(Q["p2_add_calendar"](spark, SF0001))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


@pytest.mark.parametrize("name", ["a5_hour_weekday_matrix", "a19_kpis_general", "a25_risk_tier", "a18_concentration",
                                  "a8_seasonality", "r1_report_insights", "s8_report_tables", "m20_fairness_by_group"])
def test_no_cartesian_products(spark, name):
    p = plan(Q[name](spark, SF0001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_aggregation_is_partial(spark):
    p = plan(Q["a15_mode_by_group"](spark, SF0001))
    assert "partial_count" in p


def test_broadcast_only_below_the_bound(spark):
    from sentinela.plans.hints import bounded_broadcast
    small = spark.range(5)
    big = spark.range(50)
    assert bounded_broadcast(big, max_rows=10) is big            # above the bound: no hint
    hinted = bounded_broadcast(small, max_rows=10)
    assert hinted is not small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p_hint = plan(spark.range(1000).join(hinted, "id"))
        p_plain = plan(spark.range(1000).join(bounded_broadcast(big, max_rows=10), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in p_hint
    assert "BroadcastHashJoin" not in p_plain


def test_rules_read_the_input_once_and_keep_no_cache(spark):
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    for name in ("s8_report_tables", "r1_report_insights", "r4_statistics_insights", "m21_anomaly_profile"):
        p = plan(Q[name](spark, SF0001))
        assert "Scan parquet" not in p and "InMemory" not in p      # only the settled counts
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_ranked_positions(spark):
    from sentinela.plans.hints import ranked
    got = ranked(spark.range(1000).selectExpr("id * 7 % 1000 AS v").repartition(7), ["v"], "at").collect()
    assert sorted((r["v"], r["at"]) for r in got) == [(i, i) for i in range(1000)]
    assert ranked(spark.range(0), ["id"], "at").count() == 0


def test_checkpoint_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from sentinela.session import ensure_checkpoint_dir
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake)
