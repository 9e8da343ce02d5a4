"""Rule-based scoring queries, all months."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewlake.operators import scoring as S, serving as Q
from renewlake.plans import tables as tb
from renewlake.plans.registry import query
from renewlake.sources import fixtures as fx

AUTO, UPSELL, SKIP = 20.0, 15.0, 25.0


@query("score_member")
def _(spark, sf):
    cohort = Q.model_cohort(tb.snapshot_with_means(spark, sf), fx.transactions(spark, sf))
    return S.score_members(cohort).drop("strategic_segment", "primary_risk_driver", "payment_mode")


@query("primary_driver_rule")
def _(spark, sf):
    return tb.scored_cohort(spark, sf).groupBy("snapshot_month", "primary_risk_driver").agg(
        F.count(F.lit(1)).alias("users"), F.sum("manual_flag").alias("manual"), F.sum("high_skip_flag").alias("skip"))


@query("strategic_segment")
def _(spark, sf):
    return tb.scored_cohort(spark, sf).select("snapshot_month", "msno", "strategic_segment")


@query("segment_summary")
def _(spark, sf):
    return S.segment_summary(tb.scored_cohort(spark, sf))


@query("segment_quadrant")
def _(spark, sf):
    return S.segment_quadrant(S.segment_summary(tb.scored_cohort(spark, sf)))


@query("predictive_kpis")
def _(spark, sf):
    return S.predictive_kpis(tb.scored_cohort(spark, sf))


@query("revenue_leakage")
def _(spark, sf):
    return S.revenue_leakage(tb.scored_cohort(spark, sf))


@query("forecast_decay")
def _(spark, sf):
    return S.forecast_decay(tb.scored_cohort(spark, sf))


@query("predictive_mom_delta")
def _(spark, sf):
    return S.month_over_month(S.predictive_kpis(tb.scored_cohort(spark, sf)))


@query("scenario_project")
def _(spark, sf):
    return S.scenario_project(tb.scored_cohort(spark, sf), AUTO, UPSELL, SKIP)


@query("hazard_histogram")
def _(spark, sf):
    return S.hazard_histogram(S.apply_shifts(tb.scored_cohort(spark, sf), AUTO, UPSELL, SKIP))


@query("sensitivity_1pct")
def _(spark, sf):
    return S.sensitivity_1pct(tb.scored_cohort(spark, sf))


@query("financial_waterfall")
def _(spark, sf):
    return S.financial_waterfall(S.scenario_project(tb.scored_cohort(spark, sf), AUTO, UPSELL, SKIP))
