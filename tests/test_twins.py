"""A cross-section of queries against their SQL twins at the smallest scale; check_twins.py runs all."""

import pytest
from check_twins import compare, duck

KEYS = (
    "tab1_kpis km_curve boredom_scatter snapshot_fallback model_cohort segment_quadrant hazard_histogram month_labels "
    "feature_frame cohort_alignment csv_chunk_scan guarded_rebuild clean_transactions replay_by_day stream_fact_and_kpi "
    "risk_heatmap_all previous_month_kpis daily_snapshot_series payload_cube pulse_daily score_outputs eval_metrics "
    "value_risk_matrix feature_waterfall revenue_sankey lever_summary population_risk_shift scenario_catalog mc_histogram"
).split()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_twin_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


@pytest.mark.parametrize("key", KEYS)
def test_twin(spark, sf, con, key):
    import __spark_entry__ as entry

    problem, rows = compare(entry.queries()[key](spark, sf), con, entry.oracle_sql()[key], {})
    assert problem is None and rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_properties(spark, sf):
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    q = entry.queries()
    shares = q["tab1_segment_mix_artifact"](spark, sf).groupBy("target_month", "segment_type").agg(F.sum("user_share").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-4 for r in shares.collect())
    curve = q["km_curve"](spark, sf)
    assert curve.where("survival_prob < 0 OR survival_prob > 1").count() == 0
    assert q["risk_heatmap"](spark, sf).groupBy("target_month").count().where("count <> 9").count() == 0
    assert q["daily_snapshot_series"](spark, sf).count() == 29
    bins = q["hazard_histogram"](spark, sf).groupBy("snapshot_month").count()
    assert bins.where("count <> 24").count() == 0
