"""Serving queries over snapshot and KPI tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewlake import params as P
from renewlake.operators import serving as Q, survival
from renewlake.plans import tables as tb
from renewlake.plans.registry import query
from renewlake.sources import fixtures as fx

_DIMENSIONS = list(P.SERVING_DIMENSIONS.values())


@query("segment_filter")
def _(spark, sf):
    return Q.segment_filter(tb.snapshot(spark, sf), "price_segment", "deal_<4.5").select(
        "snapshot_month", "msno", "price_segment")


@query("tab1_kpis")
def _(spark, sf):
    return Q.tab1_kpis(tb.snapshot(spark, sf))


def _km_counts(spark, sf):
    return survival.km_input(tb.snapshot(spark, sf), _DIMENSIONS, "survival_days", "churned", by=["snapshot_month"])


@query("km_input")
def _(spark, sf):
    return _km_counts(spark, sf)


@query("km_curve", digits=6)
def _(spark, sf):
    return survival.km_curve(_km_counts(spark, sf), ["snapshot_month", "dimension", "dimension_value"])


@query("segment_mix")
def _(spark, sf):
    return Q.segment_mix(tb.snapshot(spark, sf))


@query("boredom_scatter")
def _(spark, sf):
    return Q.boredom_scatter(tb.snapshot(spark, sf))


@query("tab1_month_options")
def _(spark, sf):
    return Q.month_options(tb.snapshot(spark, sf))


def _kpi_tables(spark, sf):
    return [tb.kpi_revenue(spark, sf), tb.kpi_activity(spark, sf), tb.kpi_churn_risk(spark, sf)]


@query("month_options_kpi")
def _(spark, sf):
    return Q.month_options_kpi(_kpi_tables(spark, sf), tb.snapshot(spark, sf), fx.transactions(spark, sf))


@query("latest_month")
def _(spark, sf):
    return Q.latest_month(fx.transactions(spark, sf))


@query("dashboard_metrics")
def _(spark, sf):
    return Q.dashboard_metrics(fx.transactions(spark, sf))


@query("dashboard_survival")
def _(spark, sf):
    return Q.dashboard_survival(fx.transactions(spark, sf), fx.members(spark, sf))


@query("revenue_series")
def _(spark, sf):
    return Q.revenue_series(tb.kpi_revenue(spark, sf))


@query("risk_series", digits=6)
def _(spark, sf):
    return Q.risk_series(tb.kpi_churn_risk(spark, sf))


@query("activity_series")
def _(spark, sf):
    return Q.activity_series(tb.kpi_activity(spark, sf))


@query("as_of")
def _(spark, sf):
    return Q.as_of(_kpi_tables(spark, sf)).select(F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"))


@query("snapshot_fallback")
def _(spark, sf):
    """Once with the whole snapshot, once with its realtime part alone: there earlier months fall back to the facts."""
    snapshot, tx = tb.snapshot(spark, sf), fx.transactions(spark, sf)
    facts = Q.dashboard_metrics(tx), Q.dashboard_survival(tx, fx.members(spark, sf))
    live = snapshot.where("source = 'realtime_2017_plus'")
    whole = Q.snapshot_fallback(Q.tab1_kpis(snapshot), *facts).withColumn("given", F.lit("whole"))
    return whole.unionByName(Q.snapshot_fallback(Q.tab1_kpis(live), *facts).withColumn("given", F.lit("realtime part")))


@query("model_cohort")
def _(spark, sf):
    return Q.model_cohort(tb.snapshot_with_means(spark, sf), fx.transactions(spark, sf))
