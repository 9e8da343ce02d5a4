"""Prescriptive scenarios as table jobs.

A scenario set is a handful of rows (levers, shares, presets). It rides along every
member row as an exploded literal, so one scan prices all scenarios and the sums are
merged before the shuffle. Lever parameters are one row, read as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from renewlake import params as P
from renewlake.functions import buckets as B
from renewlake.functions.cols import clip, filled, flag
from renewlake.operators.scoring import unpivot_amounts
from renewlake.params import ScenarioConfig

FEATURE_COLUMNS = (
    "renewal_segment", "price_segment", "loyalty_segment", "active_segment", "skip_segment", "discovery_segment",
    "rfm_segment", "bi_segment_name", "is_auto_renew", "is_manual_renew", "deal_hunter_flag", "free_trial_flag",
    "high_skip_flag", "low_discovery_flag", "content_fatigue_flag", "skip_ratio", "discovery_ratio",
    "expected_renewal_amount", "amt_per_day", "rfm_total_score",
)
SEGMENTS = ("renewal_segment", "price_segment", "loyalty_segment", "active_segment", "skip_segment", "discovery_segment",
            "rfm_segment", "bi_segment_name")
AMOUNT, PROB = "expected_renewal_amount", "baseline_churn_probability"


def baseline(scored: DataFrame, features: DataFrame) -> DataFrame:
    """Scored members with their features, flags (derived where absent) and eligibility per lever."""
    extra = [c for c in FEATURE_COLUMNS if c in features.columns and c not in scored.columns]
    df = scored.join(features.select("msno", "target_month", *extra), ["msno", "target_month"], "left")
    have = set(df.columns)

    def present(name: str, derived: Column) -> Column:
        return F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in have else derived

    def zero_one(name: str) -> Column:
        return clip(filled(name), 0.0, 1.0) if name in have else F.lit(0.0)

    df = df.withColumns({
        PROB: clip(filled("churn_probability"), 1e-4, 1 - 1e-4),
        AMOUNT: clip(filled(AMOUNT), 0.0),
        **{c: F.coalesce(F.col(c), F.lit("Unknown")) if c in have else F.lit("Unknown") for c in SEGMENTS},
        "skip_ratio": zero_one("skip_ratio"),
        "discovery_ratio": zero_one("discovery_ratio"),
    })
    df = df.withColumns({
        "risk_band": F.coalesce("risk_band", F.lit("Unknown")) if "risk_band" in have else B.risk_band(PROB),
        "is_manual_renew": present("is_manual_renew", flag(F.col("renewal_segment") == "Pay_Manual")),
        "deal_hunter_flag": present("deal_hunter_flag", flag(F.col("price_segment") == P.PRICE_LABELS[2])),
        "free_trial_flag": present(
            "free_trial_flag", flag((F.col("price_segment") == P.PRICE_LABELS[1]) | (F.col(AMOUNT) <= 0))),
        "high_skip_flag": present("high_skip_flag", flag(F.col("skip_ratio") >= 0.5)),
        "low_discovery_flag": present("low_discovery_flag", flag(F.col("discovery_ratio") < 0.2)),
    })
    df = df.withColumn("content_fatigue_flag", present(
        "content_fatigue_flag", flag((F.col("high_skip_flag") == 1) & (F.col("low_discovery_flag") == 1))))
    on = lambda c: F.col(c) == 1
    return df.withColumns({
        "eligible_auto": flag(on("is_manual_renew")),
        "eligible_upsell": flag(on("deal_hunter_flag") | on("free_trial_flag")),
        "eligible_engagement": flag(on("high_skip_flag") | on("low_discovery_flag") | on("content_fatigue_flag")),
        "baseline_revenue_at_risk_30d": F.col(PROB) * F.col(AMOUNT),
        "baseline_retained_revenue_30d": (1 - F.col(PROB)) * F.col(AMOUNT),
    })


def lever_parameters(base: DataFrame) -> DataFrame:
    """One row: effect of each lever from conditional means, target amounts from medians.

    Amounts are collapsed to (price segment, amount) counts first; the medians then
    take the counts as frequencies.
    """
    p = F.col(PROB)

    def mean_where(condition: Column) -> Column:
        return F.coalesce(F.avg(F.when(condition, p)), F.avg(p), F.lit(0.5))

    means = base.agg(F.struct(
        mean_where(F.col("eligible_auto") == 1).alias("manual_mean_probability"),
        mean_where(F.col("renewal_segment") == "Pay_Auto-Renew").alias("auto_mean_probability"),
        mean_where(F.col("eligible_engagement") == 1).alias("fatigue_mean_probability"),
        mean_where(F.col("eligible_engagement") == 0).alias("healthy_mean_probability"),
        mean_where(F.col("eligible_upsell") == 1).alias("deal_mean_probability"),
        mean_where(F.col("eligible_upsell") == 0).alias("paid_stable_mean_probability"),
    ).alias("m"))
    amounts = base.groupBy("price_segment", AMOUNT).agg(F.count(F.lit(1)).alias("n"))

    def median_where(condition: Column) -> Column:
        return F.percentile(F.when(condition, F.col(AMOUNT)), 0.5, F.col("n"))

    paid = median_where(F.col(AMOUNT) > 0)
    targets = amounts.agg(
        F.coalesce(median_where(F.col("price_segment") == P.PRICE_LABELS[3]), paid, F.lit(0.0)).alias("_standard"),
        F.coalesce(median_where(F.col("price_segment") == P.PRICE_LABELS[4]), paid).alias("_premium"),
    ).withColumn("m", means.scalar())
    gap = lambda a, b: F.greatest(F.col(f"m.{a}") - F.col(f"m.{b}"), F.lit(0.0))
    return targets.select(
        (-clip(gap("manual_mean_probability", "auto_mean_probability"), 0.0, 0.15) + 0.0).alias("auto_prob_delta_if_treated"),
        (-clip(gap("fatigue_mean_probability", "healthy_mean_probability"), 0.0, 0.18) + 0.0).alias("engagement_prob_delta_if_treated"),
        clip(F.col("m.paid_stable_mean_probability") - F.col("m.deal_mean_probability"), -0.15, 0.12).alias("upsell_group_gap"),
        F.col("_standard").alias("standard_target_amount"),
        F.greatest(F.coalesce("_premium", "_standard"), "_standard").alias("premium_target_amount"),
        "m.*",
    )


def as_struct(parameters: DataFrame) -> Column:
    return parameters.select(F.struct("*").alias("p")).scalar()


def upsell_target(levers: str = "_lp") -> Column:
    """Amount after an upsell: the standard price for free trials, else at least it; high value takes the premium price."""
    standard, premium = F.col(f"{levers}.standard_target_amount"), F.col(f"{levers}.premium_target_amount")
    target = F.when(F.col("free_trial_flag") == 1, standard).otherwise(F.greatest(F.col(AMOUNT), standard))
    high_value = (F.col("rfm_segment") == "High Value") | (F.coalesce(F.col("rfm_total_score"), F.lit(0)) >= 7)
    return F.when(high_value, F.greatest(target, premium)).otherwise(target)


def config_columns(config: ScenarioConfig) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in asdict(config.normalized()).items()}


def simulate(base: DataFrame, levers: Column, config: dict[str, Column]) -> DataFrame:
    """Member-level effect of a scenario; `config` holds literals or columns of an exploded scenario."""
    df = base.withColumn("_lp", levers)
    df = df.withColumns({
        "auto_treatment_weight": F.col("eligible_auto") * config["manual_to_auto_share"],
        "engagement_treatment_weight": F.col("eligible_engagement") * config["engagement_share"],
        "upsell_treatment_weight": F.col("eligible_upsell") * config["upsell_share"],
        "auto_prob_delta_if_treated": F.col("_lp.auto_prob_delta_if_treated"),
        "engagement_prob_delta_if_treated": F.col("_lp.engagement_prob_delta_if_treated"),
        "upsell_target_amount_if_treated": upsell_target(),
    })
    df = df.withColumn("upsell_amount_delta_if_treated",
                       clip(F.col("upsell_target_amount_if_treated") - F.col(AMOUNT), 0.0))
    uplift = F.col("upsell_amount_delta_if_treated") / F.greatest(F.col("upsell_target_amount_if_treated"), F.lit(1.0))
    df = df.withColumn("upsell_prob_delta_if_treated",
                       clip(F.col("_lp.upsell_group_gap") + clip(0.08 * uplift, 0.0, 0.10), -0.15, 0.12))
    df = df.withColumns({
        "auto_probability_delta": F.col("auto_treatment_weight") * F.col("auto_prob_delta_if_treated"),
        "engagement_probability_delta": F.col("engagement_treatment_weight") * F.col("engagement_prob_delta_if_treated"),
        "upsell_probability_delta": F.col("upsell_treatment_weight") * F.col("upsell_prob_delta_if_treated"),
        "upsell_amount_delta": F.col("upsell_treatment_weight") * F.col("upsell_amount_delta_if_treated"),
        "manual_to_auto_cost": F.col("auto_treatment_weight") * config["manual_to_auto_cost_per_user"],
        "upsell_cost": F.col("upsell_treatment_weight") * config["upsell_cost_per_user"],
        "engagement_cost": F.col("engagement_treatment_weight") * config["engagement_cost_per_user"],
    })
    after = (F.col(PROB) + F.col("auto_probability_delta") + F.col("engagement_probability_delta")
             + F.col("upsell_probability_delta"))
    df = df.withColumns({
        "simulated_expected_renewal_amount": F.col(AMOUNT) + F.col("upsell_amount_delta"),
        "simulated_churn_probability": clip(after, 1e-4, 1 - 1e-4),
        "campaign_cost": F.col("manual_to_auto_cost") + F.col("upsell_cost") + F.col("engagement_cost"),
    })
    amount, prob = F.col("simulated_expected_renewal_amount"), F.col("simulated_churn_probability")
    df = df.withColumns({
        "simulated_revenue_at_risk_30d": prob * amount,
        "price_only_retained_revenue_30d": (1 - F.col(PROB)) * amount,
        "simulated_retained_revenue_30d": (1 - prob) * amount,
        "simulated_risk_band": B.risk_band("simulated_churn_probability"),
    })
    kept, price_only = F.col("simulated_retained_revenue_30d"), F.col("price_only_retained_revenue_30d")
    before = F.col("baseline_retained_revenue_30d")
    return df.withColumns({
        "risk_effect_revenue_delta_30d": kept - price_only,
        "upsell_effect_revenue_delta_30d": price_only - before,
        "total_retained_revenue_delta_30d": kept - before,
    }).drop("_lp")


def _sums() -> list[Column]:
    s = lambda c, name=None: F.sum(c).alias(name or c)
    return [
        F.count(F.lit(1)).alias("population_users"),
        *[F.sum(f"eligible_{k}").alias(f"eligible_{k}_users") for k in ("auto", "upsell", "engagement")],
        *[F.sum(f"{k}_treatment_weight").alias(f"impacted_{k}_user_equivalent") for k in ("auto", "upsell", "engagement")],
        F.avg(PROB).alias("baseline_avg_churn_probability"),
        F.avg("simulated_churn_probability").alias("simulated_avg_churn_probability"),
        *[s(f"{state}_{what}_30d") for what in ("revenue_at_risk", "retained_revenue") for state in ("baseline", "simulated")],
        s(clip("risk_effect_revenue_delta_30d", 0.0), "saved_revenue_from_risk_reduction_30d"),
        s(clip(-F.col("risk_effect_revenue_delta_30d"), 0.0), "revenue_loss_from_risk_increase_30d"),
        s("upsell_effect_revenue_delta_30d", "incremental_upsell_revenue_30d"),
        s("campaign_cost", "campaign_cost_30d"),
    ]


def summarize(simulated: DataFrame, by: Sequence[str] = ("target_month",)) -> DataFrame:
    out = simulated.groupBy(*by).agg(*_sums())
    gained = F.col("simulated_retained_revenue_30d") - F.col("baseline_retained_revenue_30d")
    return out.withColumns({
        "revenue_at_risk_delta_30d": F.col("simulated_revenue_at_risk_30d") - F.col("baseline_revenue_at_risk_30d"),
        "retained_revenue_delta_30d": gained,
        "net_value_after_cost_30d": gained - F.col("campaign_cost_30d"),
    })


def with_scenarios(base: DataFrame, scenarios: Sequence[tuple[dict, ScenarioConfig]]) -> tuple[DataFrame, dict[str, Column]]:
    """Every member once per scenario. The first dict of each pair holds the scenario's labels."""
    rows = []
    for labels, config in scenarios:
        values = {**labels, **asdict(config.normalized())}
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))
    df = base.withColumn("_sc", F.explode(F.array(*rows)))
    labels = list(scenarios[0][0])
    df = df.withColumns({k: F.col(f"_sc.{k}") for k in labels})
    return df, {k: F.col(f"_sc.{k}") for k in asdict(ScenarioConfig())}


def run_scenarios(base: DataFrame, levers: Column, scenarios: Sequence[tuple[dict, ScenarioConfig]]) -> DataFrame:
    df, config = with_scenarios(base, scenarios)
    return summarize(simulate(df, levers, config), list(scenarios[0][0]))


_SHARE = {"manual_to_auto": "manual_to_auto_share", "upsell": "upsell_share", "engagement": "engagement_share"}


def lever_scenarios(config: ScenarioConfig, isolate: bool = False) -> list[tuple[dict, ScenarioConfig]]:
    """The whole scenario and each lever by itself. The other levers keep their default
    shares, or none with `isolate`."""
    config = config.normalized()
    others = ScenarioConfig(0.0, 0.0, 0.0) if isolate else ScenarioConfig()
    top = lambda c: max(c.manual_to_auto_share, c.upsell_share, c.engagement_share)
    out = [({"lever_name": "combined", "share": top(config)}, config)]
    for name, share in _SHARE.items():
        cost = f"{name}_cost_per_user"
        one = replace(others, **{share: getattr(config, share), cost: getattr(config, cost)})
        out.append(({"lever_name": name, "share": top(one)}, one))
    return out


def sensitivity_scenarios(shares: Sequence[float] = P.SENSITIVITY_SHARES, isolate: bool = False) -> list[tuple[dict, ScenarioConfig]]:
    others = ScenarioConfig(0.0, 0.0, 0.0) if isolate else ScenarioConfig()
    return [
        ({"lever_name": name, "share": float(share)}, replace(others, **{column: share}))
        for name, column in _SHARE.items()
        for share in shares
    ]


LEVER_COLUMNS = (
    "lever_name", "population_users", "baseline_avg_churn_probability", "simulated_avg_churn_probability",
    "baseline_revenue_at_risk_30d", "simulated_revenue_at_risk_30d", "revenue_at_risk_delta_30d",
    "baseline_retained_revenue_30d", "simulated_retained_revenue_30d", "retained_revenue_delta_30d",
    "saved_revenue_from_risk_reduction_30d", "incremental_upsell_revenue_30d", "campaign_cost_30d",
    "net_value_after_cost_30d", "share",
)
SENSITIVITY_COLUMNS = (
    "lever_name", "share", "simulated_avg_churn_probability", "revenue_at_risk_delta_30d", "retained_revenue_delta_30d",
    "saved_revenue_from_risk_reduction_30d", "incremental_upsell_revenue_30d", "campaign_cost_30d", "net_value_after_cost_30d",
)


def lever_summary(base: DataFrame, levers: Column, config: ScenarioConfig, isolate: bool = False) -> DataFrame:
    return run_scenarios(base, levers, lever_scenarios(config, isolate)).select(*LEVER_COLUMNS)


def sensitivity_table(base: DataFrame, levers: Column, isolate: bool = False) -> DataFrame:
    return run_scenarios(base, levers, sensitivity_scenarios(isolate=isolate)).select(*SENSITIVITY_COLUMNS)


def sensitivity_per_pct(table: DataFrame) -> DataFrame:
    per_pct = F.percentile(F.col("retained_revenue_delta_30d") / (F.col("share") * 100), 0.5)
    return table.where("share > 0").groupBy("lever_name").agg(per_pct.alias("revenue_impact_per_1pct")).select(
        B.mapped("lever_name", P.LEVER_NAMES).alias("strategy"), "revenue_impact_per_1pct")


def segment_impact(simulated: DataFrame) -> DataFrame:
    out = simulated.groupBy("target_month", F.col("bi_segment_name").alias("segment_name")).agg(
        F.count(F.lit(1)).alias("users"),
        F.avg(PROB).alias("baseline_avg_churn_probability"),
        F.avg("simulated_churn_probability").alias("simulated_avg_churn_probability"),
        *[F.sum(f"{state}_{what}_30d").alias(f"{state}_{what}_30d")
          for what in ("revenue_at_risk", "retained_revenue") for state in ("baseline", "simulated")],
        F.sum("campaign_cost").alias("campaign_cost_30d"),
    )
    return out.withColumns({
        "revenue_at_risk_delta_30d": F.col("simulated_revenue_at_risk_30d") - F.col("baseline_revenue_at_risk_30d"),
        "retained_revenue_delta_30d": F.col("simulated_retained_revenue_30d") - F.col("baseline_retained_revenue_30d"),
    })


BIN_EDGES = tuple(i / 10 for i in range(11))
BIN_LABELS = tuple(f"{i / 10:.1f}-{(i + 1) / 10:.1f}" for i in range(10))


def population_risk_shift(simulated: DataFrame, with_bands: bool = True) -> DataFrame:
    """Members per probability bin (all ten bins) and risk band, before and after."""
    def state(name: str, prob: str, band: str) -> list[Column]:
        rows = [F.struct(F.lit(name).alias("state"), F.lit("probability_bin").alias("bin_type"),
                         B.right_closed_bin(prob, BIN_EDGES, BIN_LABELS, None).alias("bin"))]
        if with_bands:
            rows.append(F.struct(F.lit(name).alias("state"), F.lit("risk_band").alias("bin_type"),
                                 F.coalesce(F.col(band), F.lit("Unknown")).alias("bin")))
        return rows

    marks = F.explode(F.array(*state("baseline", PROB, "risk_band"),
                              *state("simulated", "simulated_churn_probability", "simulated_risk_band")))
    counts = simulated.select("target_month", marks.alias("_m")).groupBy("target_month", "_m.state", "_m.bin_type", "_m.bin").agg(
        F.count(F.lit(1)).alias("users"))
    grid = counts.select("target_month").distinct().select(
        "target_month", F.explode(F.array(F.lit("baseline"), F.lit("simulated"))).alias("state"),
    ).select("target_month", "state", F.lit("probability_bin").alias("bin_type"),
             F.explode(F.array(*[F.lit(x) for x in BIN_LABELS])).alias("bin"))
    dense = grid.join(counts, ["target_month", "state", "bin_type", "bin"], "left").na.fill({"users": 0})
    bands = counts.where("bin_type = 'risk_band'")
    return dense.unionByName(bands).withColumnRenamed("bin", "probability_bin")


def risk_hist_density(shift: DataFrame) -> DataFrame:
    rows = shift.where("bin_type = 'probability_bin'")
    total = F.greatest(F.sum("users").over(Window.partitionBy("target_month", "state")), F.lit(1))  # ten rows each
    shares = rows.withColumn("d", F.col("users") / total)
    at = lambda s: F.coalesce(F.max(F.when(F.col("state") == s, F.col("d"))), F.lit(0.0))
    ends = F.split("probability_bin", "-")
    return shares.groupBy("target_month", "probability_bin").agg(
        at("baseline").alias("baseline_density"), at("simulated").alias("scenario_density")
    ).select("target_month", ends[0].cast("double").alias("bin_start"), ends[1].cast("double").alias("bin_end"),
             "baseline_density", "scenario_density")


def preset_scenarios(presets: Sequence[P.ScenarioPreset] = P.PRESETS) -> list[tuple[dict, ScenarioConfig]]:
    ids = [p.scenario_id for p in presets]
    if not ids or len(set(ids)) != len(ids):
        raise ValueError(f"scenario ids must be present and unique: {ids}")
    return [
        ({"scenario_id": p.scenario_id, "label": p.label, "is_default": int(p.scenario_id == P.DEFAULT_PRESET),
          "auto_shift_pct": p.config.manual_to_auto_share * 100, "upsell_shift_pct": p.config.upsell_share * 100,
          "skip_shift_pct": p.config.engagement_share * 100}, p.config)
        for p in presets
    ]


def scenario_catalog(base: DataFrame, levers: Column, presets: Sequence[P.ScenarioPreset] = P.PRESETS) -> DataFrame:
    """Summary of every preset."""
    return run_scenarios(base, levers, preset_scenarios(presets))


def pick_scenario(catalog: DataFrame, scenario_id: str | None, known: Sequence[P.ScenarioPreset] = P.PRESETS) -> DataFrame:
    wanted = scenario_id or P.DEFAULT_PRESET
    if wanted not in {p.scenario_id for p in known}:
        raise ValueError(f"unknown scenario id: {wanted}")
    return catalog.where(F.col("scenario_id") == wanted)


def six_month_value(probability, amount) -> Column:
    p = F.col(probability)
    return p * (1 - F.pow(p, F.lit(6))) / (1 - p + 1e-9) * F.col(amount)


WATERFALL = (
    ("Current Baseline Revenue", "baseline_retained_revenue_30d"),
    ("Saved Revenue from Retention", "saved_revenue_from_risk_reduction_30d"),
    ("Incremental Revenue from Upsell", "incremental_upsell_revenue_30d"),
    ("Scenario Revenue", "simulated_retained_revenue_30d"),
    ("Campaign Cost", "_cost"),
    ("Net Value After Cost", "net_value_after_cost_30d"),
)


def scenario_waterfall(summary: DataFrame) -> DataFrame:
    return unpivot_amounts(summary.withColumn("_cost", -F.col("campaign_cost_30d")), ["target_month"], WATERFALL)
