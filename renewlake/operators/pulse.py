"""Pre-expiry pulse: payments, listening and risk of a month's cohort in the month before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from renewlake import params as P
from renewlake.functions.cols import clip, count_if, filled, flag, month_label, month_to_date, shift_month


def cohort(features: DataFrame, month: int) -> DataFrame:
    """Members of the target month with their base risk and the risk of a day without logs."""
    unit = lambda c: clip(filled(c), 0.0, 1.0)
    members = features.where(F.col("target_month") == month)
    manual = F.when(filled("is_manual_renew") > 0, filled("is_manual_renew")).otherwise(1.0 - filled("is_auto_renew"))
    base = clip(
        0.25 * unit("skip_ratio") + 0.15 * (1.0 - unit("discovery_ratio")) + 0.15 * clip(manual, 0.0, 1.0)
        + 0.10 * unit("high_skip_flag") + 0.05 * unit("low_discovery_flag") + 0.05 * unit("content_fatigue_flag"),
        0.0, 1.0)
    risks = members.select("msno", base.alias("base_risk"))
    one = risks.groupBy("msno").agg(F.max("base_risk").alias("base_risk"))
    return one.withColumn("no_log_risk", clip(F.col("base_risk") + 0.18, 0.0, 1.0))


def _context(df: DataFrame, c: str, month: int) -> DataFrame:
    """Rows of the month before the target month."""
    end = month_to_date(F.lit(month))
    return df.where((F.col(c) >= F.add_months(end, -1)) & (F.col(c) < end))


def tx_daily(tx: DataFrame, members: DataFrame, month: int) -> DataFrame:
    """Paid amount and transactions per day; a member's day is one row before the semi join."""
    per_member = _context(tx, "transaction_date", month).groupBy("msno", F.col("transaction_date").alias("event_date")).agg(
        F.sum("actual_amount_paid").alias("paid"), F.count(F.lit(1)).alias("n"))
    return per_member.join(members.select("msno"), "msno", "left_semi").groupBy("event_date").agg(
        F.sum("paid").alias("total_revenue"), F.sum("n").alias("total_transactions"))


def log_member_day(logs: DataFrame, members: DataFrame, month: int) -> DataFrame:
    """Risk of every cohort member on every day with logs."""
    plays = F.col("num_25") + F.col("num_50") + F.col("num_75") + F.col("num_985") + F.col("num_100")
    days = _context(logs, "date", month).groupBy("msno", F.col("date").alias("event_date")).agg(
        F.sum("total_secs").alias("total_secs"),
        F.sum(F.col("num_25") + F.col("num_50")).alias("skip_num"),
        F.sum(plays).alias("play_num"),
        F.sum("num_unq").alias("disc_num"),
    )
    ratio = lambda c: F.when(F.col("play_num") > 0, F.col(c) / F.col("play_num")).otherwise(0.0)
    days = days.join(members, "msno").withColumns({
        "day_skip_ratio": ratio("skip_num"),
        "day_discovery_ratio": ratio("disc_num"),
        "low_activity_flag": flag(F.col("total_secs") < P.LOW_ACTIVITY_SECS),
    })
    risk = clip(
        F.col("base_risk") + 0.15 * F.col("low_activity_flag") + 0.07 * clip("day_skip_ratio", 0.0, 1.0)
        + 0.03 * (1.0 - clip("day_discovery_ratio", 0.0, 1.0)), 0.0, 1.0)
    return days.withColumn("risk_score", risk)


def risk_daily(member_day: DataFrame, members: DataFrame) -> DataFrame:
    """Risk of the whole cohort per day: the quiet-day total, corrected for the active members.

    No member x day grid is built; the totals are one row.
    """
    high = lambda c: count_if(F.col(c) >= P.HIGH_RISK_SCORE)
    totals = members.agg(F.struct(
        F.count(F.lit(1)).alias("size"), F.sum("no_log_risk").alias("risk"), high("no_log_risk").alias("high")).alias("t"))
    daily = member_day.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("active_users"),
        F.sum("total_secs").alias("total_listening_secs"),
        F.sum(F.col("risk_score") - F.col("no_log_risk")).alias("_shift"),
        (high("risk_score") - high("no_log_risk")).alias("_high"),
    )
    return daily.withColumn("_t", totals.scalar()).select(
        "event_date",
        "active_users",
        "total_listening_secs",
        (F.col("_t.high") + F.col("_high")).alias("high_risk_users"),
        F.coalesce(F.try_divide(F.col("_t.risk") + F.col("_shift"), F.col("_t.size")) * 100, F.lit(0.0)).alias("avg_risk_score"),
    )


def pulse_daily(tx_days: DataFrame, risk_days: DataFrame, members: DataFrame, month: int) -> DataFrame:
    """Every day of the context month, zero where nothing happened."""
    first = month_to_date(shift_month(F.lit(month), -1))
    days = tx_days.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("event_date"))
    size = members.agg(F.count(F.lit(1)).alias("n")).scalar()
    filled_days = days.join(tx_days, "event_date", "left").join(risk_days, "event_date", "left").na.fill(0)
    context = shift_month(F.lit(month), -1)
    return filled_days.withColumns({
        "target_month": F.lit(month),
        "target_month_label": month_label(F.lit(month)),
        "context_month": context,
        "context_month_label": month_label(context),
        "cohort_size": size,
        "series_mode": F.lit("pre_expiry_context"),
    })
