"""Rule-based churn score and what is derived from it, for every month of the cohort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from renewlake.functions.buckets import first_match
from renewlake.functions.cols import clip, filled
from renewlake.params import SIGNALS, Signal

DECAY_SEGMENTS = (("standard_4.5_8", "Standard"), ("deal_<4.5", "Deal Hunter"), ("premium_>=8", "Premium"))
MONTH = "snapshot_month"


# Each formula has its own numbers; all of them are fixed values.

@dataclass(frozen=True)
class SignalSum:
    """Probability of churn: a base rate and what each warning sign adds, kept away from 0 and 1."""

    signals: tuple[Signal, ...] = SIGNALS
    base_rate: float = 0.05
    bounds: tuple[float, float] = (0.01, 0.99)

    def probability(self, flags: dict[str, Column]) -> Column:
        total = F.lit(self.base_rate)
        for s in self.signals:
            total = total + s.weight * flags[s.column]
        return clip(total, *self.bounds)

    def flags(self) -> dict[str, Column]:
        return {s.column: F.col(s.column) for s in self.signals}


@dataclass(frozen=True)
class Hazard:
    """Hazard ratio: 1 for who surely stays, more with the probability and with the signs that hasten churn."""

    per_probability: float = 1.5
    least: float = 0.1

    def ratio(self, score: SignalSum, probability: Column, flags: dict[str, Column]) -> Column:
        total = 1.0 + self.per_probability * probability
        for s in sorted(score.signals, key=lambda s: -s.hazard):
            if s.hazard:
                total = total + s.hazard * flags[s.column]
        return F.greatest(total, F.lit(self.least))


@dataclass(frozen=True)
class Horizon:
    """Months looked ahead: half a year is paid for in any case, the next as likely as the member stays."""

    half_year: float = 6.0
    payment_bonus: float = 0.03  # share of value that each past payment adds

    def lifetime_value(self, paid: Column, payments: Column, probability: Column) -> Column:
        months = self.half_year + (1.0 - probability) * self.half_year
        return F.greatest(paid * months * (1.0 + payments * self.payment_bonus), F.lit(0.0))

    def at_risk(self, paid: Column, probability: Column) -> Column:
        return F.greatest(probability * paid * self.half_year, F.lit(0.0))


SCORE, HAZARD, HORIZON = SignalSum(), Hazard(), Horizon()


def _one(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def primary_driver(score: SignalSum) -> Column:
    """Largest weighted signal, the first one on a tie."""
    scores = [(s.weight * F.col(s.column), s.driver) for s in score.signals]
    best = F.greatest(*[value for value, _ in scores])
    return first_match([(value == best, name) for value, name in scores[:-1]], scores[-1][1])


def strategic_segment() -> Column:
    listener = F.when(F.col("discovery_ratio") < 0.15, "Habit Listener").when(
        F.col("discovery_ratio") < 0.35, "Balanced Listener").otherwise("Explorer Listener")
    return F.concat_ws(" / ", "price_segment", "payment_mode", listener)


def score_members(cohort: DataFrame, score: SignalSum = SCORE) -> DataFrame:
    inputs = cohort.select(
        MONTH,
        "msno",
        F.coalesce(F.nullif(F.col("price_segment"), F.lit("")), F.lit("unknown")).alias("price_segment"),
        F.greatest(filled("avg_daily_secs"), F.lit(0.0)).alias("avg_daily_secs"),
        clip(filled("skip_ratio"), 0.0, 1.0).alias("skip_ratio"),
        clip(filled("discovery_ratio"), 0.0, 1.0).alias("discovery_ratio"),
        F.greatest(filled("avg_paid"), F.lit(0.0)).alias("avg_paid"),
        F.greatest(filled("avg_plan_days", 30.0), F.lit(1.0)).alias("_plan_days"),
        F.greatest(filled("txn_count", 1.0), F.lit(1.0)).alias("txn_count"),
        (1.0 - _one(filled("is_auto_renew") >= 0.5)).alias("manual_flag"),
        _one(filled("churned") >= 0.5).alias("cancel_signal_flag"),
    )
    flagged = inputs.withColumns({
        "low_activity_flag": _one(F.col("avg_daily_secs") < 1800),
        "high_skip_flag": _one(F.col("skip_ratio") > 0.5),
        "low_discovery_flag": _one(F.col("discovery_ratio") < 0.15),
        "deal_flag": _one(F.col("price_segment") == "deal_<4.5"),
        "daily_price_est": F.greatest(F.col("avg_paid") / F.col("_plan_days"), F.lit(0.0)),
        "payment_mode": F.when(F.col("manual_flag") == 0, "Auto-Renew").otherwise("Manual Renewal"),
    })
    scored = flagged.withColumn("churn_probability", score.probability(score.flags()))
    prob, paid = F.col("churn_probability"), F.col("avg_paid")
    return scored.withColumns({
        "predicted_future_cltv": HORIZON.lifetime_value(paid, F.col("txn_count"), prob),
        "revenue_at_risk": HORIZON.at_risk(paid, prob),
        "hazard_ratio_proxy": HAZARD.ratio(score, prob, score.flags()),
        "primary_risk_driver": primary_driver(score),
        "strategic_segment": strategic_segment(),
    }).drop("_plan_days")


def segment_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy(MONTH, "strategic_segment").agg(
        F.count(F.lit(1)).alias("user_count"),
        F.avg("churn_probability").alias("avg_churn_prob"),
        (F.avg("churn_probability") * 100).alias("avg_churn_prob_pct"),
        F.avg("predicted_future_cltv").alias("avg_future_cltv"),
        F.sum("predicted_future_cltv").alias("total_future_cltv"),
        F.sum("revenue_at_risk").alias("revenue_at_risk"),
        F.mode("primary_risk_driver", deterministic=True).alias("primary_risk_driver"),
    )


def segment_quadrant(summary: DataFrame) -> DataFrame:
    """Split value at the median segment of the month, risk at 50 %."""
    middle = summary.groupBy(MONTH).agg(F.percentile("avg_future_cltv", 0.5).alias("_mid"))
    high_value = F.col("avg_future_cltv") >= F.col("_mid")
    high_risk = F.col("avg_churn_prob_pct") >= 50.0
    quadrant = first_match(
        [(high_value & high_risk, "Must Save"), (~high_value & high_risk, "Let Go"), (high_value & ~high_risk, "Loyal Core")],
        "Stable Low-Tier",
    )
    order = Window.partitionBy(MONTH).orderBy(F.col("revenue_at_risk").desc(), "strategic_segment")
    return (
        summary.join(middle, MONTH)
        .withColumn("quadrant", quadrant)
        .withColumn("risk_order", F.row_number().over(order))
        .drop("_mid")
    )


def predictive_kpis(scored: DataFrame) -> DataFrame:
    """Headline figures per month with the segment that carries most risk."""
    base = scored.groupBy(MONTH).agg(
        (F.avg("churn_probability") * 100).alias("forecasted_churn_rate"),
        F.sum("revenue_at_risk").alias("predicted_revenue_at_risk"),
        F.sum(F.when(F.col("churn_probability") <= 0.5, F.col("predicted_future_cltv")).otherwise(0.0))
        .alias("predicted_total_future_cltv"),
    )
    by_segment = scored.groupBy(MONTH, "strategic_segment").agg(
        F.sum("revenue_at_risk").alias("r"), F.count(F.lit(1)).alias("u"))
    rank = Window.partitionBy(MONTH).orderBy(F.col("r").desc(), "strategic_segment")
    top = by_segment.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").select(
        MONTH,
        F.col("strategic_segment").alias("top_segment"),
        F.col("r").alias("top_segment_risk"),
        F.col("u").alias("top_segment_user_count"),
    )
    return base.join(top, MONTH)


def revenue_leakage(scored: DataFrame) -> DataFrame:
    return scored.groupBy(MONTH, F.col("primary_risk_driver").alias("risk_driver")).agg(
        F.count(F.lit(1)).alias("user_count"), F.sum("revenue_at_risk").alias("revenue_at_risk"))


def decay_rows(rates: DataFrame, keys: list[str], monthly: Column) -> DataFrame:
    """Twelve months of retention from one monthly rate per group."""
    return rates.withColumn("_r", clip(monthly, 0.05, 0.99)).select(
        *keys, "_r", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_num")
    ).select(
        *keys,
        "month_num",
        F.concat(F.lit("T+"), F.col("month_num").cast("string")).alias("timeline"),
        (F.pow("_r", F.col("month_num")) * 100.0).alias("retention_pct"),
    )


def forecast_decay(scored: DataFrame) -> DataFrame:
    name = first_match([(F.col("price_segment") == key, label) for key, label in DECAY_SEGMENTS], None)
    rates = (
        scored.withColumn("segment", name)
        .where(F.col("segment").isNotNull())
        .groupBy(MONTH, "segment")
        .agg(F.avg("churn_probability").alias("_p"))
    )
    return decay_rows(rates, [MONTH, "segment"], 1.0 - F.col("_p") * 0.85)


def month_over_month(kpis: DataFrame) -> DataFrame:
    """Churn figure of the previous calendar month and the change in points."""
    previous = kpis.select(
        F.add_months(MONTH, 1).alias(MONTH), F.col("forecasted_churn_rate").alias("previous_forecasted_churn_rate"))
    joined = kpis.select(MONTH, "forecasted_churn_rate").join(previous, MONTH, "left")
    before = F.coalesce(F.col("previous_forecasted_churn_rate"), F.lit(0.0))
    return joined.withColumn("previous_forecasted_churn_rate", before).withColumn(
        "forecasted_churn_delta_pp_vs_prev_month", F.col("forecasted_churn_rate") - before)


# --- what-if on the rule-based score ------------------------------------------------

def apply_shifts(scored: DataFrame, auto_pct, upsell_pct, skip_pct, score: SignalSum = SCORE) -> DataFrame:
    """Per member: probability and hazard after moving the three levers (percent, 0..100)."""
    def share(value) -> Column:
        c = value if isinstance(value, Column) else F.lit(float(value))
        return clip(c, 0.0, 100.0) / 100.0

    skip_after = clip(F.col("skip_ratio") * (1.0 - share(skip_pct)), 0.0, 1.0)
    shifted = scored.withColumns({
        "_manual": F.greatest(F.col("manual_flag") * (1.0 - share(auto_pct)), F.lit(0.0)),
        "_high_skip": _one(skip_after > 0.5),
        "_upsell": share(upsell_pct),
    })
    flags = {**score.flags(), "manual_flag": F.col("_manual"), "high_skip_flag": F.col("_high_skip")}
    shifted = shifted.withColumn("scenario_probability", score.probability(flags))
    price = F.col("daily_price_est")
    return shifted.withColumns({
        "scenario_hazard": HAZARD.ratio(score, F.col("scenario_probability"), flags),
        "_baseline": price * 30.0,
        "_saved": F.greatest(F.col("churn_probability") - F.col("scenario_probability"), F.lit(0.0))
        * price * HORIZON.half_year * 30.0,
        "_gain": F.col("_upsell") * F.col("deal_flag") * price * 30.0 * 0.8,
    })


def _scenario_sums() -> list[Column]:
    return [
        F.sum("_baseline").alias("baseline_revenue"),
        F.sum("_saved").alias("saved_revenue"),
        F.sum("_gain").alias("incremental_upsell"),
        (F.sum("_baseline") + F.sum("_saved") + F.sum("_gain")).alias("optimized_revenue"),
    ]


def scenario_project(scored: DataFrame, auto_pct: float, upsell_pct: float, skip_pct: float) -> DataFrame:
    return apply_shifts(scored, auto_pct, upsell_pct, skip_pct).groupBy(MONTH).agg(
        *_scenario_sums(),
        F.avg("hazard_ratio_proxy").alias("baseline_avg_hazard"),
        F.avg("scenario_hazard").alias("scenario_avg_hazard"),
        (F.avg("churn_probability") * 100).alias("baseline_churn_prob_pct"),
        (F.avg("scenario_probability") * 100).alias("scenario_churn_prob_pct"),
    )


def hazard_histogram(shifted: DataFrame, bins: int = 24) -> DataFrame:
    """Equal bins over the joint range of both hazards, dense, the last bin closed.

    Hazards are collapsed to (month, value, state) counts first, so the two later
    passes (range, bins) read the small table.
    """
    pair = F.explode(F.array(
        F.struct(F.lit("b").alias("state"), F.col("hazard_ratio_proxy").alias("v")),
        F.struct(F.lit("s").alias("state"), F.col("scenario_hazard").alias("v")),
    ))
    counts = shifted.select(MONTH, pair.alias("x")).groupBy(MONTH, "x.v", "x.state").agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy(MONTH).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = span.withColumn("hi", F.when(F.col("hi") - F.col("lo") < 1e-9, F.col("lo") + 1.0).otherwise(F.col("hi")))
    span = span.withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    slot = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("step")).cast("int"), F.lit(bins - 1))
    hits = counts.join(span, MONTH).withColumn("bin", slot).groupBy(MONTH, "bin").agg(
        F.sum(F.when(F.col("state") == "b", F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("state") == "s", F.col("n")).otherwise(0)).alias("s"),
    )
    totals = Window.partitionBy(MONTH)
    dense = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(hits, [MONTH, "bin"], "left")
    dense = dense.na.fill({"b": 0, "s": 0})
    start = F.col("lo") + F.col("bin") * F.col("step")
    return dense.select(
        MONTH,
        "bin",
        start.alias("bin_start"),
        (start + F.col("step")).alias("bin_end"),
        (F.col("b") / F.greatest(F.sum("b").over(totals), F.lit(1))).alias("baseline_density"),
        (F.col("s") / F.greatest(F.sum("s").over(totals), F.lit(1))).alias("scenario_density"),
    )


def sensitivity_1pct(scored: DataFrame) -> DataFrame:
    """Revenue gained per lever at one percent; the three scenarios ride along each member row."""
    levers = (("Auto-Renew Conversion", 1.0, 0.0, 0.0), ("Upsell to Standard Plan", 0.0, 1.0, 0.0),
              ("Reduce Skip Behavior", 0.0, 0.0, 1.0))
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("strategy"), F.lit(a).alias("a"), F.lit(u).alias("u"), F.lit(s).alias("s"))
        for n, a, u, s in levers
    ]))
    spread = scored.withColumn("_l", rows)
    moved = apply_shifts(spread, F.col("_l.a"), F.col("_l.u"), F.col("_l.s"))
    still = apply_shifts(scored, 0.0, 0.0, 0.0).groupBy(MONTH).agg(
        (F.sum("_baseline") + F.sum("_saved") + F.sum("_gain")).alias("_base"))
    return (
        moved.groupBy(MONTH, F.col("_l.strategy").alias("strategy"))
        .agg((F.sum("_baseline") + F.sum("_saved") + F.sum("_gain")).alias("_optimized"))
        .join(still, MONTH)
        .select(MONTH, "strategy", (F.col("_optimized") - F.col("_base")).alias("revenue_impact_per_1pct"))
    )


def financial_waterfall(project: DataFrame) -> DataFrame:
    steps = (("Current Baseline Revenue", "baseline_revenue"), ("Saved Revenue from Retention", "saved_revenue"),
             ("Incremental Revenue from Upsell", "incremental_upsell"), ("Optimized Projected Revenue", "optimized_revenue"))
    return unpivot_amounts(project, [MONTH], steps)


def unpivot_amounts(df: DataFrame, keys: list[str], steps) -> DataFrame:
    rows = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), (F.col(c) + 0.0).alias("value"))
        for i, (name, c) in enumerate(steps)
    ]))
    return df.select(*keys, rows.alias("_r")).select(*keys, "_r.step", "_r.name", "_r.value")
