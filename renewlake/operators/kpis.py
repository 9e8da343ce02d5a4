"""Daily KPIs from facts, and the churn-risk profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from renewlake import params as P
from renewlake.functions.cols import count_if
from renewlake.functions.lastrow import last_flag, last_row


def transaction_kpi(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.col("transaction_date").alias("event_date")).agg(
        F.sum("actual_amount_paid").alias("total_revenue"),
        F.count(F.lit(1)).alias("total_transactions"),
        count_if(F.col("is_cancel") == 1).alias("cancel_count"),
        count_if(F.col("is_auto_renew") == 1).alias("auto_renew_count"),
    )


def activity_kpi(logs: DataFrame, date_column: str = "date") -> DataFrame:
    """Exact distinct members, seconds, mean distinct songs per log row, by day.

    Rows are first reduced to one per (day, member): the distinct count needs no
    expansion and a member with very many rows is one row in the second step.
    """
    return activity_from_member_days(member_days(logs, date_column))


def member_days(logs: DataFrame, date_column: str = "date") -> DataFrame:
    """Seconds, distinct songs and the rows that have them, by member and day; parts of a day add up."""
    return logs.groupBy(F.col(date_column).alias("event_date"), "msno").agg(
        F.sum("total_secs").alias("secs"), F.sum("num_unq").alias("unq"), F.count("num_unq").alias("rows")
    )


def activity_from_member_days(member_day: DataFrame) -> DataFrame:
    return member_day.groupBy("event_date").agg(
        F.count("msno").alias("active_users"),
        F.sum("secs").alias("total_listening_secs"),
        F.try_divide(F.sum("unq").cast("double"), F.sum("rows")).alias("avg_unique_songs"),
    )


def tx_profile(tx: DataFrame) -> DataFrame:
    """Flags of each member's last transaction."""
    return tx.groupBy("msno").agg(last_row(tx, "is_cancel", "is_auto_renew").alias("_last")).select(
        "msno",
        last_flag("_last", 0, 2).cast("double").alias("is_cancel"),
        last_flag("_last", 1, 2).cast("double").alias("is_auto_renew"),
    )


def churn_risk_features(
    logs: DataFrame, profile: DataFrame, low_activity_secs: float = P.LOW_ACTIVITY_SECS, date_column: str = "date"
) -> DataFrame:
    """Risk per member and day. The profile grows with the members, so the join strategy is
    left to the planner: it broadcasts only a side whose size it has measured."""
    daily = logs.groupBy("msno", F.col(date_column).alias("event_date")).agg(F.sum("total_secs").alias("total_secs"))
    low = F.when(F.col("total_secs") < low_activity_secs, 1.0).otherwise(0.0)
    return (
        daily.join(profile, "msno", "left")
        .na.fill({"total_secs": 0.0, "is_cancel": 0.0, "is_auto_renew": 1.0})
        .withColumn("low_activity_flag", low)
        .withColumn(
            "risk_score",
            0.4 * F.col("is_cancel") + 0.3 * (1.0 - F.col("is_auto_renew")) + 0.3 * F.col("low_activity_flag"),
        )
    )


def churn_risk_kpi(features: DataFrame, high_risk: float = P.HIGH_RISK_SCORE) -> DataFrame:
    return features.groupBy("event_date").agg(
        count_if(F.col("risk_score") >= high_risk).alias("high_risk_users"),
        F.avg("risk_score").alias("avg_risk_score"),
    )


def latest_version(df: DataFrame, keys: list[str], version: str = "processed_at") -> DataFrame:
    """One row per key: the one with the newest version. An aggregate, so versions of a hot
    key are merged before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(version, *[c for c in rest if c != version])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
