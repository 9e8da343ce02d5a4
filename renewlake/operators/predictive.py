"""Scored members and the predictive views over them.

A scored frame holds one row per member of its month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from renewlake import params as P
from renewlake.functions import buckets as B
from renewlake.functions.cols import clip, count_if, filled, flag, month_label
from renewlake.functions.ranks import cumulative_counts, percentile_rank
from renewlake.operators.scoring import SCORE, SignalSum, decay_rows
from renewlake.operators.serving import half_even

DIMENSIONS = ("price_segment", "renewal_segment", "loyalty_segment", "active_segment", "skip_segment",
              "discovery_segment", "rfm_segment", "bi_segment_name", "gender_profile")
RISK, KEPT, AMOUNT = "expected_revenue_at_risk_30d", "expected_retained_revenue_30d", "expected_renewal_amount"


def rule_probability(features: DataFrame, score: SignalSum = SCORE) -> DataFrame:
    """Deterministic probability from feature columns with the weights of the rule score."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    prob = score.probability({
        "manual_flag": one(F.col("is_auto_renew") == 0),
        "low_activity_flag": one(F.col("secs_per_log") < P.LOW_ACTIVITY_SECS),
        "high_skip_flag": one(F.col("skip_ratio") > 0.5),
        "low_discovery_flag": one(F.col("discovery_ratio") < 0.15),
        "cancel_signal_flag": one(F.col("last_1_is_churn") == 1),
    })
    return features.withColumns({"churn_probability_raw": prob, "churn_probability": prob})


def score_outputs(predicted: DataFrame) -> DataFrame:
    """Percentile, decile, band and amounts at stake for a frame with probabilities."""
    prob = F.col("churn_probability")
    label = ["is_churn"] if "is_churn" in predicted.columns else []
    dims = [c for c in DIMENSIONS if c in predicted.columns]
    base = predicted.select(
        "msno", "target_month", *label, clip(filled(AMOUNT), 0.0).alias(AMOUNT), "churn_probability_raw",
        "churn_probability", *dims)
    # Ranked in single precision: sums of the same weights in another order are ties.
    base = base.withColumn("_p", prob.cast("float").cast("double"))
    ranked = percentile_rank(base, "_p", "risk_percentile").drop("_p")
    return ranked.withColumns({
        "risk_decile": clip(F.ceil(F.col("risk_percentile") * 10), 1, 10).cast("int"),
        "risk_band": B.risk_band("churn_probability"),
        RISK: prob * F.col(AMOUNT),
        KEPT: (1 - prob) * F.col(AMOUNT),
    })


def segment_risk_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("target_month", "bi_segment_name").agg(
        F.count(F.lit(1)).alias("users"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        F.sum(RISK).alias(f"total_{RISK}"),
        F.sum(KEPT).alias(f"total_{KEPT}"),
        F.sum(AMOUNT).alias(f"total_{AMOUNT}"),
    )


def eval_metrics(scored: DataFrame, label: str = "is_churn", prob: str = "churn_probability") -> DataFrame:
    """Log loss, average precision, ROC AUC, positive rate and mean prediction, exact, one row.

    Works on (probability, count, positives); ranks come from cumulative counts, so no
    window spans the table.
    """
    p = clip(F.col(prob), 1e-15, 1 - 1e-15)
    y = F.col(label).cast("double")
    rows = scored.select(p.alias("p"), y.alias("y"))
    c = cumulative_counts(rows, "p", {"pos": F.col("y")})
    totals = c.agg(F.struct(F.sum("n").alias("n"), F.sum("pos").alias("pos")).alias("t")).scalar()
    c = c.withColumn("_t", totals)
    n, pos = F.col("_t.n"), F.col("_t.pos")
    at_least = n - F.col("n_before")
    hits = pos - F.col("pos_before")
    precision_step = F.try_divide(F.col("pos"), pos) * hits / at_least
    mean_rank = F.col("n_before") + (F.col("n") + 1) / 2
    loss = -(F.col("pos") * F.log("p") + (F.col("n") - F.col("pos")) * F.log(1 - F.col("p")))
    negatives = F.max(n) - F.max(pos)
    rank_sum = F.sum(F.col("pos") * mean_rank)
    return c.agg(
        (F.sum(loss) / F.max(n)).alias("log_loss"),
        F.sum(precision_step).alias("pr_auc"),
        (F.max(pos) / F.max(n)).alias("positive_rate"),
        (F.sum(F.col("p") * F.col("n")) / F.max(n)).alias("prediction_mean"),
        F.try_divide(rank_sum - F.max(pos) * (F.max(pos) + 1) / 2, F.max(pos) * negatives).alias("roc_auc"),
    )


# --- payload ------------------------------------------------------------------------

def driver(with_skip: bool = True) -> Column:
    rules = [(F.col("renewal_segment") == "Pay_Manual", "Manual Renewal")]
    if with_skip:
        rules.append((F.col("skip_segment") == "High >= 50%", "High Skip Ratio"))
    rules += [
        (F.col("discovery_segment") == "Habit < 20%", "Low Discovery"),
        (F.col("price_segment").isin("Deal Hunter < 4.5", "Free Trial / Zero Pay"), "Price Sensitivity"),
        (F.col("loyalty_segment").isin("New < 30d", "Growing 30-179d"), "Early Lifecycle"),
    ]
    return B.first_match(rules, "Mixed Behavioral Risk")


def recommended_action(driver_column: str) -> Column:
    return B.mapped(driver_column, P.RECOMMENDED_ACTIONS, P.RECOMMENDED_ACTIONS["Mixed Behavioral Risk"])


MATRIX_COLUMNS = ("strategic_segment", "user_count", "avg_churn_prob", "avg_churn_prob_pct", "avg_future_cltv",
                  "total_future_cltv", "revenue_at_risk", "primary_risk_driver", "recommended_action", "quadrant")


def _quadrants(matrix: DataFrame) -> DataFrame:
    """Split value and risk at the medians over segments (a small table)."""
    middle = matrix.agg(F.struct(
        F.percentile("avg_future_cltv", 0.5).alias("v"), F.percentile("avg_churn_prob_pct", 0.5).alias("r")).alias("m")).scalar()
    m = matrix.withColumn("_m", middle)
    value, risk = F.col("avg_future_cltv") >= F.col("_m.v"), F.col("avg_churn_prob_pct") >= F.col("_m.r")
    quadrant = B.first_match([(value & risk, "Must Save"), (~value & risk, "At Risk"), (value & ~risk, "Core Value")], "Monitor")
    return m.withColumns({"quadrant": quadrant, "recommended_action": recommended_action("primary_risk_driver")}).select(*MATRIX_COLUMNS)


def matrix_from_members(scored: DataFrame) -> DataFrame:
    grouped = scored.withColumn("_d", driver()).groupBy(
        F.coalesce("bi_segment_name", F.lit("Unknown")).alias("strategic_segment")
    ).agg(
        F.count(F.lit(1)).alias("user_count"),
        F.avg("churn_probability").alias("avg_churn_prob"),
        F.sum(KEPT).alias("total_future_cltv"),
        F.sum(RISK).alias("revenue_at_risk"),
        F.mode("_d", deterministic=True).alias("primary_risk_driver"),
    )
    return _quadrants(grouped.withColumns({
        "avg_churn_prob_pct": F.col("avg_churn_prob") * 100,
        "avg_future_cltv": F.col("total_future_cltv") / F.greatest(F.col("user_count"), F.lit(1)),
    }))


def matrix_from_summary(summary: DataFrame) -> DataFrame:
    rows = summary.select("*", *B.split_segment_name("bi_segment_name"))
    users = F.coalesce("users", F.lit(0)).cast("long")
    kept = filled(f"total_{KEPT}")
    return _quadrants(rows.select(
        F.coalesce("bi_segment_name", F.lit("Unknown")).alias("strategic_segment"),
        users.alias("user_count"),
        filled("avg_churn_probability").alias("avg_churn_prob"),
        (filled("avg_churn_probability") * 100).alias("avg_churn_prob_pct"),
        (kept / F.greatest(users, F.lit(1))).alias("avg_future_cltv"),
        kept.alias("total_future_cltv"),
        filled(f"total_{RISK}").alias("revenue_at_risk"),
        driver(with_skip=False).alias("primary_risk_driver"),
    ))


def top_segment(matrix: DataFrame) -> Column:
    """Segment with most risk, as a one-row struct."""
    row = F.struct("revenue_at_risk", "avg_churn_prob", "strategic_segment", "user_count")
    return matrix.agg(F.max_by(row, F.struct("revenue_at_risk", "avg_churn_prob", "strategic_segment")).alias("t")).scalar()


def summary_kpis(matrix: DataFrame) -> DataFrame:
    weighted = F.coalesce(F.try_divide(F.sum(F.col("avg_churn_prob") * F.col("user_count")), F.sum("user_count")), F.lit(0.0))
    one = matrix.agg(
        (weighted * 100).alias("forecasted_churn_rate"),
        F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias("predicted_revenue_at_risk"),
        F.coalesce(F.sum("total_future_cltv"), F.lit(0.0)).alias("predicted_total_future_cltv"),
    ).withColumn("_t", top_segment(matrix))
    return _with_top(one)


def _with_top(one: DataFrame) -> DataFrame:
    return one.withColumns({
        "top_segment": F.coalesce("_t.strategic_segment", F.lit("N/A")),
        "top_segment_risk": F.coalesce("_t.revenue_at_risk", F.lit(0.0)),
        "top_segment_user_count": F.coalesce("_t.user_count", F.lit(0)),
    }).drop("_t")


def member_kpis(scored: DataFrame, matrix: DataFrame) -> DataFrame:
    high = filled("churn_probability") >= P.HIGH_RISK_SCORE
    one = scored.agg(
        F.coalesce(F.avg(flag(high)) * 100, F.lit(0.0)).alias("forecasted_churn_rate"),
        F.coalesce(count_if(high), F.lit(0)).alias("high_flight_risk_users"),
        F.coalesce(F.sum(RISK), F.lit(0.0)).alias("predicted_revenue_at_risk"),
        F.coalesce(F.sum(KEPT), F.lit(0.0)).alias("predicted_total_future_cltv"),
        F.coalesce(F.sum(KEPT), F.lit(0.0)).alias("safe_revenue"),
    ).withColumn("_t", top_segment(matrix))
    return _with_top(one)


def leakage_from_members(scored: DataFrame) -> DataFrame:
    return scored.groupBy(driver().alias("risk_driver")).agg(
        F.count(F.lit(1)).alias("user_count"), F.sum(RISK).alias("revenue_at_risk"))


def leakage_from_matrix(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy(F.col("primary_risk_driver").alias("risk_driver")).agg(
        F.sum("user_count").alias("user_count"), F.sum("revenue_at_risk").alias("revenue_at_risk"))


def risk_band_mix(scored: DataFrame) -> DataFrame:
    grouped = scored.groupBy(B.risk_tier("risk_band").alias("band")).agg(
        F.count(F.lit(1)).alias("user_count"), F.sum(RISK).alias("revenue_at_risk"))
    total = F.sum("revenue_at_risk").over(Window.partitionBy())  # at most four rows
    order = B.first_match([(F.col("band") == b, i) for i, b in enumerate(P.RISK_TIER_ORDER)], 99)
    return grouped.withColumns({
        "revenue_share_pct": F.coalesce(F.try_divide(F.col("revenue_at_risk"), total) * 100, F.lit(0.0)),
        "sort_order": order,
    })


def feature_group(feature: str | Column) -> Column:
    c = F.col(feature) if isinstance(feature, str) else feature
    return B.first_match([(c.isin(*names), group) for group, names in P.FEATURE_GROUPS.items()], "other")


def group_importance(importance: DataFrame) -> DataFrame:
    return importance.withColumn("feature_group", feature_group("feature")).groupBy("feature_group").agg(
        F.sum("importance_gain").alias("importance_gain"),
        F.sum("importance_split").alias("importance_split"),
        F.count("feature").alias("feature_count"),
    )


def feature_waterfall(importance: DataFrame, scored: DataFrame, base_share: float = 0.30) -> DataFrame:
    """Base share of the risk, the rest split over feature groups by their gain."""
    total = scored.agg(F.sum(RISK).alias("r")).scalar()
    groups = group_importance(importance).where("importance_gain > 0")  # at most six rows
    share = F.col("importance_gain") / F.sum("importance_gain").over(Window.partitionBy())
    rows = groups.withColumn("contribution", total * (1 - base_share) * share)
    base = scored.sparkSession.range(1).select(
        F.lit("base_risk").alias("feature_group"), F.lit(0.0).alias("importance_gain"),
        F.lit(0).cast("long").alias("importance_split"), F.lit(0).cast("long").alias("feature_count"),
        (total * base_share).alias("contribution"))
    out = rows.unionByName(base).withColumns({
        "display_name": B.mapped("feature_group", P.FEATURE_GROUP_LABELS),
        "contribution_pct": F.coalesce(F.try_divide(F.col("contribution"), total) * 100, F.lit(0.0)),
    })
    # Base first, then groups by gain.
    order = Window.partitionBy().orderBy(
        F.when(F.col("feature_group") == "base_risk", 0).otherwise(1), F.col("importance_gain").desc(), "feature_group")
    return out.where(total > 0).withColumn("position", F.row_number().over(order))


def executive_matrix(scored: DataFrame, filtered_for_display: bool = True) -> DataFrame:
    """Users and risk by rounded probability, amount and band."""
    grouped = scored.groupBy(
        "target_month",
        half_even(clip(filled("churn_probability"), 0.0, 1.0), 1).alias("prob_bin"),
        clip(filled(AMOUNT), 0.0).alias(AMOUNT),
        F.coalesce("risk_band", F.lit("Unknown")).alias("risk_band"),
    ).agg(F.count(F.lit(1)).alias("user_count"), F.sum(RISK).alias("revenue_at_risk"))
    if filtered_for_display:
        grouped = grouped.where((F.col(AMOUNT) <= P.MATRIX_MAX_AMOUNT) & (F.col("user_count") >= P.MATRIX_MIN_USERS))
    likely, valuable = F.col("prob_bin") >= 0.5, F.col(AMOUNT) >= 100.0
    quadrant = B.first_match(
        [(likely & valuable, "VIP Rescue"), (likely & ~valuable, "Price Sensitive"), (~likely & valuable, "Core Loyal")], "Casual")
    return grouped.withColumns({
        "month_label": month_label("target_month"),
        "risk_tier": B.risk_tier("risk_band"),
        "display_size": F.sqrt(F.greatest(F.col("user_count"), F.lit(1))),
        "priority_quadrant": quadrant,
    })


def sankey_nodes() -> list[str]:
    tiers = [P.RISK_TIER_LABELS[t] for t in ("High", "Medium", "Low")]
    return [*P.SANKEY_RENEWAL.values(), *P.SANKEY_RFM.values(), *P.SANKEY_PRICE.values(), *tiers]


def revenue_sankey(scored: DataFrame) -> DataFrame:
    """Three levels of links renewal -> value -> price -> risk; one scan feeds all of them."""
    nodes = sankey_nodes()
    rows = scored.select(
        B.mapped("renewal_segment", P.SANKEY_RENEWAL).alias("a"), B.mapped("rfm_segment", P.SANKEY_RFM).alias("b"),
        B.mapped("price_segment", P.SANKEY_PRICE).alias("c"), B.risk_tier_label("risk_band").alias("risk_tier"), F.col(RISK).alias("v"),
    ).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
    small = rows.groupBy("a", "b", "c", "risk_tier").agg(F.sum("v").alias("v"))
    links = F.explode(F.array(
        F.struct(F.lit(1).alias("level"), F.col("a").alias("s"), F.col("b").alias("t")),
        F.struct(F.lit(2).alias("level"), F.col("b").alias("s"), F.col("c").alias("t")),
        F.struct(F.lit(3).alias("level"), F.col("c").alias("s"), F.col("risk_tier").alias("t")),
    ))
    index = lambda c: B.first_match([(F.col(c) == n, i) for i, n in enumerate(nodes)], None)
    return (
        small.select("risk_tier", "v", links.alias("l"))
        .groupBy("l.level", "l.s", "l.t", "risk_tier")
        .agg(F.sum("v").alias("value"))
        .where("value > 0")
        .select("level", F.col("s").alias("source_name"), F.col("t").alias("target_name"), "risk_tier", "value",
                index("s").alias("source"), index("t").alias("target"))
    )


def price_paradox(scored: DataFrame) -> DataFrame:
    rows = scored.withColumn("price_bucket", B.mapped("price_segment", P.PARADOX_PRICE)).where("price_bucket IS NOT NULL")
    order = B.first_match([(F.col("price_bucket") == b, i) for i, b in enumerate(P.PARADOX_PRICE.values())], 99)
    return rows.groupBy("price_bucket").agg(
        F.count(F.lit(1)).alias("user_count"), F.sum(RISK).alias("revenue_at_risk"),
        (F.avg("churn_probability") * 100).alias("churn_rate_pct")).withColumn("sort_order", order)


def habit_funnel(scored: DataFrame) -> DataFrame:
    rows = scored.withColumn("habit_stage", B.mapped("active_segment", P.HABIT_STAGES)).where("habit_stage IS NOT NULL")
    grouped = rows.groupBy("habit_stage").agg(
        F.count(F.lit(1)).alias("user_count"), F.sum(RISK).alias("revenue_at_risk"))
    top = F.greatest(F.max("user_count").over(Window.partitionBy()), F.lit(1))  # at most three rows
    return grouped.withColumn("share_of_top_pct", F.col("user_count") / top * 100)


def decay_by_price(scored: DataFrame) -> DataFrame:
    rates = scored.where(F.col("price_segment").isin(*P.PRICE_LABELS[2:])).groupBy(
        F.col("price_segment").alias("segment")).agg(F.avg("churn_probability").alias("_p"))
    return decay_rows(rates, ["segment"], 1.0 - F.col("_p"))


def decay_of_top_segments(matrix: DataFrame, top: int = 4) -> DataFrame:
    rows = matrix.orderBy(F.col("revenue_at_risk").desc(), F.col("avg_churn_prob").desc(), "strategic_segment").limit(top)
    rates = rows.select(F.col("strategic_segment").alias("segment"), F.col("avg_churn_prob").alias("_p"))
    return decay_rows(rates, ["segment"], 1.0 - F.col("_p"))


def loss_outlook(scored: DataFrame, horizons: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    rows = scored.select(clip(filled(AMOUNT), 0.0).alias("a"), clip(filled("churn_probability"), 0.0, 1.0).alias("p"))
    sums = rows.agg(F.sum("a").alias("total"), *[
        F.sum(F.col("a") * (1.0 - F.pow(1.0 - F.col("p"), F.lit(h)))).alias(f"h{h}") for h in horizons])
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"h{h}").alias("loss")) for h in horizons]))
    return sums.where("total > 0").select("total", each.alias("x")).select(
        F.col("x.h").alias("horizon_months"),
        F.concat(F.col("x.h").cast("string"), F.lit(" tháng")).alias("horizon_label"),
        F.col("x.loss").alias("projected_revenue_loss"),
        (F.col("x.loss") / F.col("total") * 100).alias("projected_loss_share_pct"),
    )


def prescriptions(matrix: DataFrame, rows: int = P.PRESCRIPTION_ROWS) -> DataFrame:
    """First rows of the matrix by risk."""
    return matrix.orderBy(F.col("revenue_at_risk").desc(), F.col("avg_churn_prob").desc(), "strategic_segment").limit(rows)


def with_previous(kpis: DataFrame, metrics: DataFrame) -> DataFrame:
    """Churn figure of the validation month beside the current one, and the change in points."""
    mean = F.col("prediction_mean")
    before = metrics.select(F.when(mean <= 1.0, mean * 100).otherwise(mean).alias("p")).scalar()
    return kpis.withColumn("previous_forecasted_churn_rate", before).withColumn(
        "forecasted_churn_delta_pp_vs_prev_month", F.col("forecasted_churn_rate") - F.col("previous_forecasted_churn_rate"))
