"""Prescriptive scenario and Monte Carlo queries for the score month."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from renewlake.operators import montecarlo as N, scenario as X
from renewlake.params import ScenarioConfig
from renewlake.plans.feature_store import features
from renewlake.plans.predictive import scored
from renewlake.plans.registry import query
from renewlake.plans.stages import read_stage, stage
from renewlake.sources import files, fixtures as fx
from renewlake.sources.scratch import new_path

CONFIG = ScenarioConfig(0.20, 0.15, 0.25, 2.0, 1.5, 1.0)


@stage("scenario_baseline")
def _baseline_stage(spark, sf):
    return X.baseline(scored(spark, sf), features(spark, sf).where(F.col("target_month") == fx.SCORE_MONTH))


@stage("lever_parameters")
def _levers_stage(spark, sf):
    return X.lever_parameters(read_stage(spark, sf, "scenario_baseline"))


def base(spark, sf) -> DataFrame:
    return read_stage(spark, sf, "scenario_baseline")


def levers(spark, sf):
    return X.as_struct(read_stage(spark, sf, "lever_parameters"))


@stage("scenario_members")
def _members_stage(spark, sf):
    return X.simulate(base(spark, sf), levers(spark, sf), X.config_columns(CONFIG))


def simulated(spark, sf) -> DataFrame:
    return read_stage(spark, sf, "scenario_members")


def _summary(spark, sf):
    return X.summarize(simulated(spark, sf))


@query("scenario_baseline", digits=6)
def _(spark, sf):
    return _baseline_stage(spark, sf).select(
        "msno", "target_month", "baseline_churn_probability", "expected_renewal_amount", "risk_band", "bi_segment_name",
        "skip_ratio", "discovery_ratio", "is_manual_renew", "deal_hunter_flag", "free_trial_flag", "high_skip_flag",
        "low_discovery_flag", "content_fatigue_flag", "eligible_auto", "eligible_upsell", "eligible_engagement",
        "baseline_revenue_at_risk_30d", "baseline_retained_revenue_30d", "rfm_total_score")


@query("scenario_baseline_derived", digits=6)
def _(spark, sf):
    # A feature snapshot without the flags: they are derived from segments and ratios.
    own = features(spark, sf).where(F.col("target_month") == fx.SCORE_MONTH).select(
        "msno", "target_month", "skip_ratio", "discovery_ratio")
    return X.baseline(scored(spark, sf), own).select(
        "msno", "is_manual_renew", "deal_hunter_flag", "free_trial_flag", "high_skip_flag", "low_discovery_flag",
        "content_fatigue_flag", "eligible_auto", "eligible_upsell", "eligible_engagement")


@query("lever_parameters", digits=6)
def _(spark, sf):
    return X.lever_parameters(base(spark, sf))


@query("upsell_target")
def _(spark, sf):
    rows = base(spark, sf).withColumn("_lp", levers(spark, sf))
    return rows.select("msno", "free_trial_flag", "rfm_segment", "expected_renewal_amount", X.upsell_target().alias("target_amount"))


@query("scenario_member_level", digits=6)
def _(spark, sf):
    return X.simulate(base(spark, sf), levers(spark, sf), X.config_columns(CONFIG)).select(
        "msno", "auto_treatment_weight", "engagement_treatment_weight", "upsell_treatment_weight",
        "upsell_target_amount_if_treated", "upsell_amount_delta_if_treated", "upsell_prob_delta_if_treated",
        "simulated_expected_renewal_amount", "simulated_churn_probability", "simulated_revenue_at_risk_30d",
        "price_only_retained_revenue_30d", "simulated_retained_revenue_30d", "risk_effect_revenue_delta_30d",
        "upsell_effect_revenue_delta_30d", "total_retained_revenue_delta_30d", "simulated_risk_band", "campaign_cost")


@query("scenario_summary")
def _(spark, sf):
    return _summary(spark, sf)


@query("lever_summary")
def _(spark, sf):
    shared = X.lever_summary(base(spark, sf), levers(spark, sf), CONFIG).withColumn("isolate", F.lit(0))
    alone = X.lever_summary(base(spark, sf), levers(spark, sf), CONFIG, isolate=True).withColumn("isolate", F.lit(1))
    return shared.unionByName(alone)


@query("segment_impact")
def _(spark, sf):
    return X.segment_impact(simulated(spark, sf))


@query("population_risk_shift")
def _(spark, sf):
    return X.population_risk_shift(simulated(spark, sf))


@query("sensitivity_table")
def _(spark, sf):
    return X.sensitivity_table(base(spark, sf), levers(spark, sf))


@query("sensitivity_per_pct")
def _(spark, sf):
    return X.sensitivity_per_pct(X.sensitivity_table(base(spark, sf), levers(spark, sf)))


@query("risk_hist_density", digits=6)
def _(spark, sf):
    return X.risk_hist_density(X.population_risk_shift(simulated(spark, sf), with_bands=False))


@query("scenario_catalog")
def _(spark, sf):
    path = new_path(spark, "scenario-catalog")
    files.write_parquet(X.scenario_catalog(base(spark, sf), levers(spark, sf)), path, ("scenario_id",))
    stored = spark.read.parquet(path)
    chosen = X.pick_scenario(stored, None).withColumn("picked", F.lit(1))
    return stored.withColumn("picked", F.lit(0)).unionByName(chosen)


@query("six_month_value")
def _(spark, sf):
    rows = base(spark, sf).withColumn("value", X.six_month_value("baseline_churn_probability", "expected_renewal_amount"))
    return rows.groupBy("bi_segment_name").agg(F.count(F.lit(1)).alias("users"), F.sum("value").alias("six_month_value"))


@query("scenario_waterfall")
def _(spark, sf):
    return X.scenario_waterfall(_summary(spark, sf))


# --- Monte Carlo ---------------------------------------------------------------------------

@query("simulation_units", digits=6)
def _(spark, sf):
    return N.simulation_units(simulated(spark, sf))


@stage("monte_carlo_runs")
def _runs_stage(spark, sf):
    return N.monte_carlo_runs(N.simulation_units(simulated(spark, sf)))


@query("monte_carlo_runs")
def _(spark, sf):
    return read_stage(spark, sf, "monte_carlo_runs")


@query("monte_carlo_probabilities")
def _(spark, sf):
    return N.win_probabilities(read_stage(spark, sf, "monte_carlo_runs"))


@query("monte_carlo_run_percentiles")
def _(spark, sf):
    return N.metric_percentiles(read_stage(spark, sf, "monte_carlo_runs"))


@query("mc_run_histogram")
def _(spark, sf):
    return N.net_value_histogram(read_stage(spark, sf, "monte_carlo_runs"))


@query("monte_carlo_invariants")
def _(spark, sf):
    return N.run_invariants(read_stage(spark, sf, "monte_carlo_runs"), N.simulation_units(simulated(spark, sf)))


def _standin_runs(spark, sf) -> DataFrame:
    """A runs table without random draws: one run per expiry day and city of the members."""
    days = features(spark, sf).where(F.col("target_month") == fx.SCORE_MONTH).select("msno", "expire_day", "city")
    rows = simulated(spark, sf).join(days, "msno")
    s = lambda c: F.sum(c)
    return rows.groupBy("expire_day", "city").agg(
        s("baseline_retained_revenue_30d").alias("baseline_retained_revenue_30d"),
        s("simulated_retained_revenue_30d").alias("scenario_retained_revenue_30d"),
        s("upsell_effect_revenue_delta_30d").alias("incremental_upsell_revenue_30d"),
        s("risk_effect_revenue_delta_30d").alias("saved_revenue_from_risk_reduction_30d"),
        s("campaign_cost").alias("campaign_cost_30d"),
        (s("total_retained_revenue_delta_30d") - s("campaign_cost")).alias("net_value_after_cost_30d"),
        (F.avg("baseline_churn_probability") * 100).alias("baseline_churn_prob_pct"),
        (F.avg("simulated_churn_probability") * 100).alias("scenario_churn_prob_pct"),
    )


@query("monte_carlo_percentiles")
def _(spark, sf):
    return N.metric_percentiles(_standin_runs(spark, sf))


@query("monte_carlo_win_shares")
def _(spark, sf):
    return N.win_probabilities(_standin_runs(spark, sf))


@query("mc_histogram")
def _(spark, sf):
    return N.net_value_histogram(_standin_runs(spark, sf))
