"""Descriptive, pulse and view queries over the feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewlake import params as P
from renewlake.functions import buckets as B, cols as C
from renewlake.operators import descriptive as D, pulse as E, scoring, serving as Q, views as W
from renewlake.plans import tables as tb
from renewlake.plans.feature_store import features
from renewlake.plans.registry import query
from renewlake.plans.stages import read_stage, stage
from renewlake.sources import fixtures as fx

EXCLUDED = (fx.SCORE_MONTH,)


def tab1(spark, sf):
    return D.tab1_features(features(spark, sf))


def _kpis(spark, sf):
    return D.monthly_kpis(tab1(spark, sf))


def trend(spark, sf):
    return D.trend_from_features(features(spark, sf), _kpis(spark, sf), EXCLUDED)


# --- scalar rules ---------------------------------------------------------------------

@query("segment_name_split")
def _(spark, sf):
    names = features(spark, sf).groupBy("bi_segment_name").agg(F.count(F.lit(1)).alias("users"))
    cut = names.withColumn("name", F.when(F.col("users") % 2 == 0, F.substring_index("bi_segment_name", "|", 2))
                           .otherwise(F.col("bi_segment_name")))
    return cut.select("name", "users", *B.split_segment_name("name"))


@query("rate_to_pct")
def _(spark, sf):
    kpis = D.monthly_kpis(tab1(spark, sf))
    return kpis.select("target_month", C.rate_to_pct("historical_churn_rate").alias("from_share"),
                       C.rate_to_pct(F.col("historical_churn_rate") * 100 + 1).alias("from_pct"),
                       C.rate_to_pct(F.when(F.col("target_month") > 202306, F.col("auto_renew_rate"))).alias("with_gaps"))


@query("normalized_churn_prob")
def _(spark, sf):
    rate = F.when(F.col("target_month") % 2 == 0, F.col("churn_rate") * 100).otherwise(F.col("churn_rate"))
    return features(spark, sf).groupBy("target_month", "churn_rate").agg(
        F.max(C.churn_probability_from_rate(rate)).alias("probability"), F.count(F.lit(1)).alias("users"))


# --- artifacts ---------------------------------------------------------------------------

@query("tab1_features", digits=6)
def _(spark, sf):
    return tab1(spark, sf).select(
        "msno", "target_month", "month_label", "is_churn", "is_auto_renew", "survival_days_proxy", "txn_freq_bucket",
        "skip_ratio_bucket", "skip_ratio", "discovery_ratio", "expected_renewal_amount", "age_segment", "gender_profile")


@query("tab1_monthly_kpis")
def _(spark, sf):
    return _kpis(spark, sf)


@query("tab1_km_artifact", digits=6)
def _(spark, sf):
    return D.km_artifact(tab1(spark, sf))


@query("tab1_segment_mix_artifact", digits=6)
def _(spark, sf):
    return D.segment_mix_artifact(tab1(spark, sf))


@query("tab1_boredom_artifact")
def _(spark, sf):
    return D.boredom_artifact(tab1(spark, sf))


@query("tab1_latest_snapshot")
def _(spark, sf):
    return D.latest_snapshot(tab1(spark, sf)).select("msno", "target_month", "month_label", "survival_days_proxy", "expected_renewal_amount")


@query("trend_monthly")
def _(spark, sf):
    return D.trend_monthly(features(spark, sf), EXCLUDED)


def _risk_source(spark, sf):
    all_months = features(spark, sf)
    train = all_months.where(F.col("target_month") < fx.SCORE_MONTH)
    score = all_months.where(F.col("target_month") == fx.SCORE_MONTH)
    return D.risk_source(train, score, D.latest_snapshot(tab1(spark, sf)), fx.SCORE_MONTH)


@query("risk_source_merge")
def _(spark, sf):
    return _risk_source(spark, sf).groupBy("target_month", "price_segment").agg(
        F.count(F.lit(1)).alias("users"), F.sum("free_trial_flag").alias("trials"), F.sum("deal_hunter_flag").alias("deals"),
        F.sum("churn_rate").alias("rates"))


@query("risk_heatmap_all")
def _(spark, sf):
    return D.risk_heatmap_all(_risk_source(spark, sf))


# --- payload -------------------------------------------------------------------------------

@query("tab1_frame_kpis")
def _(spark, sf):
    return D.frame_kpis(tab1(spark, sf))


@query("behavior_clusters")
def _(spark, sf):
    return D.behavior_clusters(tab1(spark, sf))


@query("trend_from_features")
def _(spark, sf):
    return trend(spark, sf)


@query("trend_normalise")
def _(spark, sf):
    # An older table: no average revenue, no churned users, no movement, rates as shares.
    older = D.trend_monthly(features(spark, sf), EXCLUDED).drop("apru", "churned_users", "net_movement", "month_label")
    return D.trend_normalise(older.withColumn("auto_renew_rate", F.col("auto_renew_rate") / 100), EXCLUDED)


@query("trend_from_kpis")
def _(spark, sf):
    # The last trend month is made to look censored, so the historical rate steps in.
    kpis = _kpis(spark, sf).withColumn(
        "historical_churn_rate", F.when(F.col("target_month") == fx.VALID_MONTH, 1.0).otherwise(F.col("historical_churn_rate")))
    return D.trend_from_kpis(kpis, features(spark, sf), EXCLUDED)


@query("risk_heatmap")
def _(spark, sf):
    return D.risk_heatmap(features(spark, sf))


@query("risk_heatmap_normalised")
def _(spark, sf):
    return D.normalise_heatmap(D.risk_heatmap_all(_risk_source(spark, sf)).drop("month_label", "analysis_month"))


@query("daily_snapshot_series")
def _(spark, sf):
    return D.daily_snapshot_series(features(spark, sf), fx.SCORE_MONTH)


@query("churn_breakdown")
def _(spark, sf):
    return D.churn_breakdown(D.frame_kpis(tab1(spark, sf)))


@query("chart_context_month")
def _(spark, sf):
    heat = D.normalise_heatmap(D.risk_heatmap_all(_risk_source(spark, sf)))
    return D.chart_context(trend(spark, sf), heat, fx.SCORE_MONTH)


@query("segment_mix_payload")
def _(spark, sf):
    return D.segment_mix_payload(features(spark, sf))


def _whole_and_gap(kpis, run):
    """The result for all months, and for a table that lacks one of them."""
    return run(kpis).withColumn("given", F.lit("all months")).unionByName(
        run(kpis.where("target_month <> 202309")).withColumn("given", F.lit("one missing")))


@query("previous_month_kpis")
def _(spark, sf):
    # All months, and again with one month's snapshot missing: its successor takes the trend point.
    own, points = D.frame_kpis(tab1(spark, sf)), trend(spark, sf)
    return _whole_and_gap(own, lambda kpis: D.previous_month_kpis(kpis, points))


@query("km_lookup")
def _(spark, sf):
    curves = D.km_lookup(D.km_artifact(tab1(spark, sf)), fx.SCORE_MONTH, "age_segment")
    point = lambda p: F.concat_ws(":", p["day"], p["at_risk"], p["events"])
    return curves.select("dimension_value", F.size("points").alias("n"),
                         F.array_join(F.transform("points", point), ",").alias("points"))


@query("snapshot_metrics")
def _(spark, sf):
    frame = tab1(spark, sf)
    return _whole_and_gap(_kpis(spark, sf), lambda kpis: D.snapshot_metrics(kpis, frame))


@stage("pulse")
def _pulse_stage(spark, sf):
    members = E.cohort(features(spark, sf), fx.SCORE_MONTH)
    tx_days = E.tx_daily(fx.transactions(spark, sf), members, fx.SCORE_MONTH)
    member_day = E.log_member_day(fx.user_logs(spark, sf), members, fx.SCORE_MONTH)
    return E.pulse_daily(tx_days, E.risk_daily(member_day, members), members, fx.SCORE_MONTH)


@query("pulse_overlay")
def _(spark, sf):
    daily = D.daily_snapshot_series(features(spark, sf), fx.SCORE_MONTH)
    return D.pulse_overlay(daily, read_stage(spark, sf, "pulse"))


@query("available_months")
def _(spark, sf):
    frame = features(spark, sf).select("target_month")
    served = tb.snapshot(spark, sf).select(C.yyyymm("snapshot_month").alias("target_month"))
    scored = frame.where(F.col("target_month") >= fx.VALID_MONTH)
    both = D.available_months([served, scored], all_required=True).withColumn("mode", F.lit("all"))
    any_of = D.available_months([served, frame, scored], all_required=False).withColumn("mode", F.lit("any"))
    return both.unionByName(any_of)


@query("filter_enumeration")
def _(spark, sf):
    return D.filter_enumeration(features(spark, sf))


@query("payload_cube")
def _(spark, sf):
    return D.payload_cube(tab1(spark, sf))


# --- pulse ------------------------------------------------------------------------------------

def _members(spark, sf):
    return E.cohort(features(spark, sf), fx.SCORE_MONTH)


@query("pulse_cohort", digits=6)
def _(spark, sf):
    return _members(spark, sf)


@query("pulse_tx_daily")
def _(spark, sf):
    return E.tx_daily(fx.transactions(spark, sf), _members(spark, sf), fx.SCORE_MONTH)


@query("pulse_log_user_day")
def _(spark, sf):
    return E.log_member_day(fx.user_logs(spark, sf), _members(spark, sf), fx.SCORE_MONTH)


@query("pulse_risk_daily")
def _(spark, sf):
    members = _members(spark, sf)
    return E.risk_daily(E.log_member_day(fx.user_logs(spark, sf), members, fx.SCORE_MONTH), members)


@query("pulse_daily")
def _(spark, sf):
    return _pulse_stage(spark, sf)


# --- views -------------------------------------------------------------------------------------

@query("pulse_merge")
def _(spark, sf):
    return W.merge_series(
        Q.revenue_series(tb.kpi_revenue(spark, sf)), Q.risk_series(tb.kpi_churn_risk(spark, sf)),
        Q.activity_series(tb.kpi_activity(spark, sf)))


@query("km_pivot")
def _(spark, sf):
    """All four dimensions as rows, with the labels of all as columns."""
    labels = dict.fromkeys((*P.AGE_LABELS, *P.GENDER_LABELS, "low", "medium", "high", "low_skip", "mid_skip", "high_skip"))
    value = F.when(F.lower("dimension_value") == "unknown", "Unknown").otherwise(F.col("dimension_value"))
    curve = D.km_artifact(tab1(spark, sf)).withColumn("dimension_value", value)
    return W.km_pivot(curve, ["target_month", "dimension"], list(labels))


@query("decay_pivot")
def _(spark, sf):
    return W.decay_pivot(scoring.forecast_decay(tb.scored_cohort(spark, sf)), ["snapshot_month"], ["Standard", "Deal Hunter", "Premium"])


@query("series_delta")
def _(spark, sf):
    return W.series_delta(Q.revenue_series(tb.kpi_revenue(spark, sf)), ["total_revenue", "total_transactions"])


@query("descriptive_highlights")
def _(spark, sf):
    return W.segment_highlights(D.segment_mix_payload(features(spark, sf)))


@query("behavior_focus")
def _(spark, sf):
    return W.behavior_focus(D.behavior_clusters(tab1(spark, sf)))


@query("renewed_users")
def _(spark, sf):
    return W.renewed_users(trend(spark, sf))
