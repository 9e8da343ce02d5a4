"""Descriptive views over the feature store, all months in one pass.

Frames hold one row per member and month (features.duplicate_members checks it),
so users are counted as rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from renewlake import params as P
from renewlake.functions import buckets as B
from renewlake.functions.cols import (
    churn_probability_from_rate, clip, days_in_month, filled, flag, month_label, month_to_date, rate_to_pct, shift_month,
)
from renewlake.functions.ranks import exact_quantiles
from renewlake.operators import survival

MONTH = "target_month"
EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
ARTIFACT_BINS = ("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")
CLUSTER_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.000001)
CLUSTER_BINS = {"0-20%": 0.10, "20-40%": 0.30, "40-60%": 0.50, "60-80%": 0.70, "80-100%": 0.90}


def users() -> Column:
    return F.count(F.lit(1)).alias("users")


def _segments(df: DataFrame, *kept: str) -> DataFrame:
    """One row per segment column of each member."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("t"), F.coalesce(F.col(c), F.lit("Unknown")).alias("v")) for c in P.SEGMENT_COLUMNS
    ]))
    return df.select(*kept, pairs.alias("_s")).select(
        *kept, F.col("_s.t").alias("segment_type"), F.col("_s.v").alias("segment_value"))


# --- artifacts ---------------------------------------------------------------------

def tab1_features(frame: DataFrame) -> DataFrame:
    rows_so_far = "historical_transaction_rows" if "historical_transaction_rows" in frame.columns else "transaction_count"
    return frame.withColumns({
        "month_label": month_label(MONTH),
        "is_churn": F.coalesce("is_churn", F.lit(0)),
        "is_auto_renew": F.coalesce("is_auto_renew", F.lit(0)),
        "expected_renewal_amount": clip(filled("expected_renewal_amount"), 0.0),
        "membership_age_days": F.coalesce("membership_age_days", F.lit(-1)),
        "survival_days_proxy": F.greatest(F.coalesce(F.col("membership_age_days"), F.lit(-1)), F.lit(1)).cast("int"),
        "skip_ratio": clip(filled("skip_ratio"), 0.0, 1.0),
        "discovery_ratio": clip(filled("discovery_ratio"), 0.0, 1.0),
        "txn_freq_bucket": B.txn_freq_bucket_or_unknown(rows_so_far),
        **{c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("age_segment", "gender_profile", *P.SEGMENT_COLUMNS)},
    }).withColumn("skip_ratio_bucket", B.skip_bucket("skip_ratio"))


def monthly_kpis(tab1: DataFrame) -> DataFrame:
    return tab1.groupBy(MONTH, "month_label").agg(
        F.count(F.lit(1)).alias("total_expiring_users"),
        F.avg("is_churn").alias("historical_churn_rate"),
        F.percentile("survival_days_proxy", 0.5).alias("median_survival_days_proxy"),
        F.avg("is_auto_renew").alias("auto_renew_rate"),
        F.sum("expected_renewal_amount").alias("total_expected_renewal_amount"),
    )


def km_artifact(tab1: DataFrame) -> DataFrame:
    counts = survival.km_input(tab1, P.FEATURE_DIMENSIONS, "survival_days_proxy", "is_churn", by=[MONTH])
    curve = survival.km_curve(counts, [MONTH, "dimension", "dimension_value"], full_origin=True)
    return curve.withColumn("month_label", month_label(MONTH))


def segment_mix_artifact(tab1: DataFrame) -> DataFrame:
    mix = _segments(tab1, MONTH).groupBy(MONTH, "segment_type", "segment_value").agg(users())
    totals = tab1.groupBy(MONTH).agg(F.count(F.lit(1)).alias("_total"))
    return mix.join(totals, MONTH).select(
        MONTH, "segment_type", "segment_value", "users", (F.col("users") / F.col("_total")).alias("user_share"),
        month_label(MONTH).alias("month_label"))


def boredom_artifact(tab1: DataFrame) -> DataFrame:
    return tab1.groupBy(
        MONTH,
        B.right_closed_bin("discovery_ratio", EDGES, ARTIFACT_BINS).alias("discovery_bin"),
        B.right_closed_bin("skip_ratio", EDGES, ARTIFACT_BINS).alias("skip_bin"),
    ).agg(
        users(),
        F.avg("is_churn").alias("avg_churn_rate"),
        F.avg("expected_renewal_amount").alias("avg_expected_renewal_amount"),
    ).withColumn("month_label", month_label(MONTH))


def latest_snapshot(tab1: DataFrame) -> DataFrame:
    newest = tab1.agg(F.max(MONTH).alias("m")).scalar()
    return tab1.where(F.col(MONTH) == newest)


def trend_monthly(train: DataFrame, excluded_months: tuple[int, ...] = ()) -> DataFrame:
    rows = train.where(F.col(MONTH).isNotNull() & F.col("msno").isNotNull() & ~F.col(MONTH).isin(list(excluded_months) or [0]))
    grouped = rows.groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("subscribers"),
        F.sum(clip(filled("expected_renewal_amount"), 0.0)).alias("revenue"),
        (F.avg(clip(filled("is_churn"), 0.0, 1.0)) * 100).alias("churn_rate"),
        F.sum(flag(F.col("loyalty_segment") == P.LOYALTY_LABELS[1])).alias("new_paid_users"),
        F.sum(clip(filled("is_churn"), 0.0, 1.0)).cast("long").alias("churned_users"),
        (F.avg(clip(filled("is_auto_renew"), 0.0, 1.0)) * 100).alias("auto_renew_rate"),
        F.percentile(clip(filled("membership_age_days"), 1.0), 0.5).alias("overall_median_survival"),
    )
    return grouped.withColumns({
        "apru": F.try_divide("revenue", "subscribers"),
        "churned_users_diverging": -F.col("churned_users"),
        "net_movement": F.col("new_paid_users") - F.col("churned_users"),
        "month_label": month_label(MONTH),
        "analysis_month": month_to_date(MONTH),
    })


def risk_source(train: DataFrame, score: DataFrame, snapshot: DataFrame | None, score_month: int) -> DataFrame:
    """Train and score rows; the score month is taken from its snapshot when there is one."""
    wanted = (MONTH, "msno", "price_segment", "free_trial_flag", "deal_hunter_flag", "churn_rate")
    rows = train.select(*wanted).unionByName(score.select(*wanted))
    if snapshot is None:
        return rows
    own = snapshot.withColumn(MONTH, F.lit(score_month)).select(*wanted)
    return rows.where(F.col(MONTH) != score_month).unionByName(own)


def _dense_heatmap(counts: DataFrame, months: DataFrame, risk_name: str) -> DataFrame:
    """All nine cells per month, zero where empty; the grid is nine literals per month row."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(v).alias("v"), F.lit(r).alias("r"), F.lit(i + 1).alias("vo"), F.lit(j + 1).alias("ro"))
        for i, v in enumerate(P.VALUE_TIERS) for j, r in enumerate(P.RISK_SEGMENTS)
    ]))
    grid = months.select(MONTH, cells.alias("_c")).select(
        MONTH, F.col("_c.v").alias("value_tier"), F.col("_c.r").alias(risk_name),
        F.col("_c.vo").alias("value_tier_order"), F.col("_c.ro").alias("risk_segment_order"))
    return grid.join(counts, [MONTH, "value_tier", risk_name], "left")


def risk_heatmap_all(source: DataFrame) -> DataFrame:
    """Months x value tier x risk segment. Rates above 1 anywhere mean the column is in percent."""
    rate = filled("churn_rate", -1.0)
    in_percent = source.agg(F.max(rate).alias("m")).scalar() > 1.0
    rows = source.where(F.col(MONTH).isNotNull() & F.col("msno").isNotNull()).withColumn(
        "_rate", F.when(in_percent & (rate >= 0), rate / 100.0).otherwise(rate))
    counts = rows.groupBy(
        MONTH, B.value_tier("price_segment", "free_trial_flag", "deal_hunter_flag").alias("value_tier"),
        B.risk_segment("_rate").alias("risk_customer_segment"),
    ).agg(F.count(F.lit(1)).alias("subscribers"))
    months = counts.select(MONTH).distinct()
    return _dense_heatmap(counts, months, "risk_customer_segment").na.fill({"subscribers": 0}).withColumns({
        "month_label": month_label(MONTH), "analysis_month": month_to_date(MONTH)})


# --- payload ------------------------------------------------------------------------

def _kpi_aggs() -> list[Column]:
    probability = churn_probability_from_rate("churn_rate")
    amount = clip(filled("expected_renewal_amount"), 0.0)
    return [
        F.count(F.lit(1)).alias("total_expiring_users"),
        (F.avg(probability) * 100).alias("historical_churn_rate"),
        F.coalesce(F.percentile("survival_days_proxy", 0.5), F.lit(0.0)).alias("overall_median_survival"),
        (F.avg(filled("is_auto_renew")) * 100).alias("auto_renew_rate"),
        F.sum(amount).alias("total_expected_renewal_amount"),
        F.sum(amount * probability).alias("historical_revenue_at_risk"),
    ]


def frame_kpis(tab1: DataFrame, by: tuple[str, ...] = (MONTH,)) -> DataFrame:
    return tab1.groupBy(*by).agg(*_kpi_aggs())


def behavior_clusters(tab1: DataFrame) -> DataFrame:
    """Riskiest cells of the 5 x 5 grid per month: a fifth of the cells, at least five."""
    labels = tuple(CLUSTER_BINS)
    probability = churn_probability_from_rate("churn_rate")
    amount = clip(filled("expected_renewal_amount"), 0.0)
    cells = tab1.groupBy(
        MONTH,
        B.left_closed_bin(clip(filled("discovery_ratio"), 0.0, 1.0), CLUSTER_EDGES, labels).alias("discovery_bin"),
        B.left_closed_bin(clip(filled("skip_ratio"), 0.0, 1.0), CLUSTER_EDGES, labels).alias("skip_bin"),
    ).agg(
        users(),
        F.avg(amount).alias("avg_expected_renewal_amount"),
        (F.avg(probability) * 100).alias("churn_rate_pct"),
        F.sum(amount * probability).alias("revenue_at_risk"),
    )
    order = Window.partitionBy(MONTH).orderBy(
        F.col("revenue_at_risk").desc(), F.col("users").desc(), F.col("churn_rate_pct").desc(), "discovery_bin", "skip_bin")
    keep = F.greatest(F.lit(5), F.ceil(F.count(F.lit(1)).over(Window.partitionBy(MONTH)) * 0.2))
    ranked = cells.withColumns({"_rank": F.row_number().over(order), "_keep": keep})
    middle = {str(k): v for k, v in CLUSTER_BINS.items()}

    def midpoint(c: str) -> Column:
        return B.first_match([(F.col(c) == k, v) for k, v in middle.items()], 0.0)

    return ranked.where(F.col("_rank") <= F.col("_keep")).drop("_rank", "_keep").withColumns({
        "discovery_ratio": midpoint("discovery_bin"),
        "skip_ratio": midpoint("skip_bin"),
        "cluster_label": F.concat(F.lit("Kham pha "), F.col("discovery_bin"), F.lit(" • Bo qua "), F.col("skip_bin")),
    })


TREND_COLUMNS = (
    MONTH, "month_label", "total_expiring_users", "historical_churn_rate", "overall_median_survival", "auto_renew_rate",
    "total_expected_renewal_amount", "historical_revenue_at_risk", "apru", "new_paid_users", "churned_users", "net_movement",
)


def trend_from_features(train: DataFrame, kpis: DataFrame, excluded_months: tuple[int, ...] = ()) -> DataFrame:
    grouped = train.where(~F.col(MONTH).isin(list(excluded_months) or [0])).groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("total_expiring_users"),
        (F.avg(filled("is_churn")) * 100).alias("historical_churn_rate"),
        (F.avg(filled("is_auto_renew")) * 100).alias("auto_renew_rate"),
        F.sum(clip(filled("expected_renewal_amount"), 0.0)).alias("total_expected_renewal_amount"),
        F.sum(flag(F.col("loyalty_segment") == P.LOYALTY_LABELS[1])).cast("long").alias("new_paid_users"),
        F.sum(filled("is_churn")).cast("long").alias("churned_users"),
    )
    medians = kpis.select(MONTH, F.col("median_survival_days_proxy").alias("_median"))
    return grouped.join(medians, MONTH, "left").withColumns({
        "month_label": month_label(MONTH),
        "overall_median_survival": F.coalesce("_median", F.lit(0.0)),
        "historical_revenue_at_risk": F.col("total_expected_renewal_amount") * F.col("historical_churn_rate") / 100.0,
        "apru": F.try_divide("total_expected_renewal_amount", "total_expiring_users"),
        "net_movement": F.col("new_paid_users") - F.col("churned_users"),
    }).select(*TREND_COLUMNS)


def trend_normalise(table: DataFrame, excluded_months: tuple[int, ...] = ()) -> DataFrame:
    """Trend table of any vintage -> the payload columns: renamed, rates in percent, gaps derived."""
    def pick(*names: str) -> Column:
        for n in names:
            if n in table.columns:
                return F.col(n).cast("double")
        return F.lit(None).cast("double")

    labels = F.nullif(F.col("month_label"), F.lit("")) if "month_label" in table.columns else F.lit(None).cast("string")
    rows = table.where(F.col(MONTH).isNotNull() & ~F.col(MONTH).isin(list(excluded_months) or [0])).select(
        F.col(MONTH).cast("int").alias(MONTH),
        F.coalesce(labels, month_label(MONTH)).alias("month_label"),
        F.coalesce(pick("total_expiring_users", "subscribers"), F.lit(0.0)).cast("long").alias("total_expiring_users"),
        rate_to_pct(pick("historical_churn_rate", "churn_rate")).alias("historical_churn_rate"),
        F.coalesce(pick("overall_median_survival", "median_survival_days_proxy"), F.lit(0.0)).alias("overall_median_survival"),
        rate_to_pct(pick("auto_renew_rate")).alias("auto_renew_rate"),
        pick("total_expected_renewal_amount", "revenue").alias("total_expected_renewal_amount"),
        pick("historical_revenue_at_risk").alias("_risk"),
        pick("apru").alias("_apru"),
        pick("new_paid_users").alias("_new"),
        pick("churned_users").alias("_churned"),
        pick("net_movement").alias("_net"),
    )
    amount, users, rate = F.col("total_expected_renewal_amount"), F.col("total_expiring_users"), F.col("historical_churn_rate")
    churned = F.coalesce("_churned", F.rint(users * rate / 100.0))
    return rows.withColumn("_churned", churned).select(
        *TREND_COLUMNS[:7],
        F.coalesce("_risk", amount * rate / 100.0).alias("historical_revenue_at_risk"),
        F.coalesce("_apru", F.when(users > 0, amount / users)).alias("apru"),
        F.rint("_new").cast("long").alias("new_paid_users"),
        F.rint("_churned").cast("long").alias("churned_users"),
        F.rint(F.coalesce("_net", F.col("_new") - F.col("_churned"))).cast("long").alias("net_movement"),
    )


def _clean_rate(frame: DataFrame) -> DataFrame:
    """Mean of the known historical churn rates per month, in percent."""
    return frame.groupBy(MONTH).agg((F.avg(F.when(F.col("churn_rate") >= 0, F.col("churn_rate"))) * 100).alias("_clean"))


def trend_from_kpis(kpis: DataFrame, frame: DataFrame, excluded_months: tuple[int, ...] = ()) -> DataFrame:
    """Trend without the feature frame; a rate of 99 % or more (censored month) takes the historical one."""
    given = rate_to_pct("historical_churn_rate")
    rows = kpis.where(~F.col(MONTH).isin(list(excluded_months) or [0])).join(_clean_rate(frame), MONTH, "left")
    rate = F.when(given >= 99.0, F.coalesce("_clean", given)).otherwise(given)
    rows = rows.withColumns({"historical_churn_rate": rate, "auto_renew_rate": rate_to_pct("auto_renew_rate")})
    amount, users = F.col("total_expected_renewal_amount"), F.col("total_expiring_users")
    return rows.withColumns({
        "month_label": month_label(MONTH),
        "overall_median_survival": F.coalesce("median_survival_days_proxy", F.lit(0.0)),
        "historical_revenue_at_risk": amount * F.col("historical_churn_rate") / 100.0,
        "apru": F.when(users > 0, amount / users),
        "new_paid_users": F.lit(None).cast("long"),
        "churned_users": F.rint(users * F.col("historical_churn_rate") / 100.0).cast("long"),
        "net_movement": F.lit(None).cast("long"),
    }).select(*TREND_COLUMNS)


def risk_heatmap(frame: DataFrame) -> DataFrame:
    counts = frame.groupBy(
        MONTH, B.value_tier("price_segment", "free_trial_flag", "deal_hunter_flag").alias("value_tier"),
        B.risk_segment("churn_rate").alias("risk_segment"),
    ).agg(users())
    return _dense_heatmap(counts, counts.select(MONTH).distinct(), "risk_segment").na.fill({"users": 0}).drop(
        "value_tier_order", "risk_segment_order")


def normalise_heatmap(precomputed: DataFrame) -> DataFrame:
    """Payload shape of the precomputed heat map, dense again."""
    rows = precomputed.withColumnsRenamed({"risk_customer_segment": "risk_segment", "subscribers": "users"})
    counts = rows.groupBy(MONTH, "value_tier", "risk_segment").agg(F.sum("users").alias("users"))
    return _dense_heatmap(counts, rows.select(MONTH).distinct(), "risk_segment").na.fill({"users": 0}).drop(
        "value_tier_order", "risk_segment_order")


def daily_snapshot_series(frame: DataFrame, month: int) -> DataFrame:
    """Revenue, risk and activity by expiry day of one month, every calendar day present."""
    unit = lambda c: clip(filled(c), 0.0, 1.0)
    rows = frame.where((F.col(MONTH) == month) & F.col("expire_day").between(1, days_in_month(F.lit(month))))
    amount = clip(filled("expected_renewal_amount"), 0.0)
    rows = rows.select(
        F.col("expire_day").cast("int").alias("expire_day"),
        F.when(amount > 0, amount).otherwise(clip(filled("actual_amount_paid"), 0.0)).alias("revenue_proxy"),
        clip(filled("total_secs_sum"), 0.0).alias("secs"),
        clip(0.45 * unit("skip_ratio") + 0.25 * (1.0 - unit("discovery_ratio")) + 0.15 * unit("is_manual_renew")
             + 0.10 * unit("high_skip_flag") + 0.03 * unit("low_discovery_flag") + 0.02 * unit("content_fatigue_flag"),
             0.0, 1.0).alias("risk_score"),
        F.col("active_segment").isin(*P.ACTIVE_LABELS[2:]).alias("listens"),
    )
    quarter = exact_quantiles(rows, "risk_score", {"q": 0.75}).select(clip("q", 0.40, 0.70).alias("q"))
    high = F.col("risk_score") >= quarter.scalar()
    daily = rows.groupBy("expire_day").agg(
        F.sum("revenue_proxy").alias("total_revenue"),
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(flag(high)).alias("high_risk_users"),
        (F.avg("risk_score") * 100).alias("avg_risk_score"),
        F.sum(flag((F.col("secs") > 0) | F.col("listens"))).alias("active_users"),
        F.sum("secs").alias("total_listening_secs"),
    )
    return _every_day(frame.sparkSession, month).withColumn("expire_day", F.dayofmonth("event_date")).join(
        daily, "expire_day", "left").na.fill(0).drop("expire_day")


def _every_day(spark, month: int) -> DataFrame:
    first = month_to_date(F.lit(month))
    return spark.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("event_date"))


def churn_breakdown(kpis: DataFrame) -> DataFrame:
    """Renewed and churned users from the total and the churn rate in percent."""
    total = F.greatest(F.col("total_expiring_users"), F.lit(0))
    rate = clip("historical_churn_rate", 0.0, 100.0)
    churned = clip(F.rint(total * rate / 100.0).cast("long"), 0)
    churned = F.least(churned, total)
    return kpis.select(
        MONTH,
        (total - churned).alias("renewed_users"),
        churned.alias("churned_users"),
        F.when(total > 0, 100.0 - rate).otherwise(0.0).alias("renewed_rate"),
        rate.alias("churned_rate"),
    )


def chart_context(trend: DataFrame, heatmap: DataFrame, month: int) -> DataFrame:
    """Breakdown and heat map of the latest trend month that is not after the target month."""
    usable = trend.where(F.col(MONTH) <= month)
    latest = usable.agg(F.max(MONTH).alias("m")).select(F.coalesce("m", F.lit(month)).alias("m"))
    context = latest.scalar()
    point = usable.where(F.col(MONTH) == context).withColumn("historical_churn_rate", rate_to_pct("historical_churn_rate"))
    parts = churn_breakdown(point)
    return heatmap.where(F.col(MONTH) == context).join(parts, MONTH, "left").withColumn("requested_month", F.lit(month))


def segment_mix_payload(frame: DataFrame) -> DataFrame:
    known = F.when(F.col("churn_rate") >= 0, F.col("churn_rate"))
    rate = F.coalesce(F.avg(known) * 100, F.lit(0.0))
    return _segments(frame, MONTH, "churn_rate").groupBy(MONTH, "segment_type", "segment_value").agg(
        users(), rate.alias("churn_rate_pct"), (100.0 - rate).alias("retain_rate_pct"))


KPI_COLUMNS = ("total_expiring_users", "historical_churn_rate", "overall_median_survival", "auto_renew_rate",
               "total_expected_renewal_amount", "historical_revenue_at_risk")


def previous_month_kpis(kpis: DataFrame, trend: DataFrame) -> DataFrame:
    """KPIs of the month before; where its snapshot is missing, the last earlier trend point."""
    k = kpis.select(MONTH, F.struct(MONTH, *KPI_COLUMNS).alias("k"))
    before = k.select(shift_month(MONTH, 1).alias(MONTH), F.col("k").alias("b"))
    points = trend.select(MONTH, F.struct(MONTH, *KPI_COLUMNS).alias("p"))
    # One row per calendar month, so the un-partitioned window is a few dozen rows.
    past = Window.orderBy(MONTH).rowsBetween(Window.unboundedPreceding, -1)
    joined = k.join(points, MONTH, "full_outer").withColumn("p", F.last("p", ignorenulls=True).over(past))
    picked = joined.where(F.col("k").isNotNull()).join(before, MONTH, "left").withColumn(
        "x", F.when(F.col("b").isNotNull(), F.col("b")).otherwise(F.col("p")))
    return picked.select(
        MONTH, F.col(f"x.{MONTH}").alias("previous_month"), *[F.col(f"x.{c}").alias(c) for c in KPI_COLUMNS])


def km_lookup(km: DataFrame, month: int, dimension: str) -> DataFrame:
    """Curves of one month and dimension, the points of a value nested in day order."""
    points = F.sort_array(F.collect_list(F.struct("day", "survival_prob", "at_risk", "events")))
    return km.where((F.col(MONTH) == month) & (F.col("dimension") == dimension)).groupBy("dimension_value").agg(
        points.alias("points"))


def snapshot_metrics(kpis: DataFrame, frame: DataFrame) -> DataFrame:
    """KPI row of each month, or figures from the snapshot where there is none."""
    own = frame.groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(F.col("churn_rate") >= 0, F.col("churn_rate"))) * 100).alias("clean"),
        F.percentile("survival_days_proxy", 0.5).alias("median"),
        (F.avg("is_auto_renew") * 100).alias("auto"),
    )
    given = rate_to_pct("historical_churn_rate")
    fixed = F.when((given >= 99.0) & F.col("clean").isNotNull(), F.col("clean")).otherwise(given)
    has = F.col("total_expiring_users").isNotNull()
    joined = own.join(kpis, MONTH, "full_outer")
    return joined.select(
        MONTH,
        F.coalesce("total_expiring_users", "n").alias("total_expiring_users"),
        F.when(has, fixed).otherwise(F.coalesce("clean", F.lit(0.0))).alias("historical_churn_rate"),
        F.when(has, F.col("median_survival_days_proxy")).otherwise(F.coalesce("median", F.lit(0.0))).alias("median_survival_days"),
        F.when(has, rate_to_pct("auto_renew_rate")).otherwise(F.col("auto")).alias("auto_renew_rate"),
    )


def pulse_overlay(daily: DataFrame, pulse: DataFrame) -> DataFrame:
    """The pulse series when there is one, else the snapshot's daily series."""
    present = pulse.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    columns = ("event_date", "total_revenue", "total_transactions", "high_risk_users", "avg_risk_score", "active_users",
               "total_listening_secs")
    return pulse.select(*columns).unionByName(daily.where(~present).select(*columns))


def available_months(sets: list[DataFrame], all_required: bool) -> DataFrame:
    """Months known to every set, or to any of them."""
    months = [s.select(month_label(MONTH).alias("month")).distinct() for s in sets]
    if all_required:
        return reduce(DataFrame.intersect, months)
    return reduce(DataFrame.unionByName, months).distinct()


def filter_enumeration(frame: DataFrame) -> DataFrame:
    values = _segments(frame).distinct()
    none = frame.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("segment_type"), F.lit(None).cast("string").alias("segment_value"))
    return values.unionByName(none)


def payload_cube(tab1: DataFrame) -> DataFrame:
    """KPIs of every month under every segment filter, and under none, in one aggregation."""
    filters = F.explode(F.array(
        F.struct(F.lit("all").alias("t"), F.lit("all").alias("v")),
        *[F.struct(F.lit(c).alias("t"), F.col(c).alias("v")) for c in P.SEGMENT_COLUMNS],
    ))
    needed = ("churn_rate", "expected_renewal_amount", "survival_days_proxy", "is_auto_renew")
    rows = tab1.select(MONTH, *needed, filters.alias("_f")).select(
        MONTH, *needed, F.col("_f.t").alias("segment_type"), F.col("_f.v").alias("segment_value"))
    return frame_kpis(rows, (MONTH, "segment_type", "segment_value"))
