"""Result shaping for the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MUST_SAVE = "Must Save"


def merge_series(revenue: DataFrame, risk: DataFrame, activity: DataFrame) -> DataFrame:
    """Three daily series side by side, every date of any, zero where a series has none."""
    return revenue.join(risk, "event_date", "full_outer").join(activity, "event_date", "full_outer").na.fill(0)


def km_pivot(km: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per day, one column per dimension value, survival in percent.

    The values are given, so no extra job looks for them.
    """
    return km.groupBy(*keys, "day").pivot("dimension_value", values).agg(F.min(F.col("survival_prob") * 100))


def decay_pivot(decay: DataFrame, keys: list[str], segments: list[str]) -> DataFrame:
    return decay.groupBy(*keys, "month_num", "timeline").pivot("segment", segments).agg(F.first("retention_pct"))


def running_waterfall(steps: DataFrame) -> DataFrame:
    """Start and running total of each step (a handful of rows), with the closing total."""
    order = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select("position", F.col("display_name").alias("name"), F.col("contribution").alias("amount"),
                        "contribution_pct", "feature_count").withColumn("total", F.sum("amount").over(order))
    return rows.withColumn("start", F.col("total") - F.col("amount"))


def must_save_rollup(matrix: DataFrame) -> DataFrame:
    mine = F.col("quadrant") == MUST_SAVE
    return matrix.agg(
        F.coalesce(F.sum(F.when(mine, F.col("user_count"))), F.lit(0)).alias("user_count"),
        F.coalesce(F.sum(F.when(mine, F.col("revenue_at_risk"))), F.lit(0.0)).alias("revenue_at_risk"),
    )


def priority_rows(matrix: DataFrame, rows: int = 6) -> DataFrame:
    """Export list: first rows by risk, amounts in whole units, halves up.

    Sums of doubles end in digits that depend on the order of their rows. They are cut off
    first, so that a sum of exactly 2.5 is 3 in whatever order it was added.
    """
    top = matrix.orderBy(F.col("revenue_at_risk").desc(), F.col("avg_churn_prob").desc(), "strategic_segment").limit(rows)
    whole = lambda c: F.floor(F.round(c, 6) + 0.5)
    return top.select("strategic_segment", "quadrant", "user_count", whole("revenue_at_risk").alias("revenue_at_risk"),
                      whole("avg_future_cltv").alias("avg_future_cltv"), "primary_risk_driver", "recommended_action")


def top_by_risk(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.agg(
        F.lit(kind).alias("kind"),
        F.max_by(name, F.struct("revenue_at_risk", name)).alias("name"),
        F.max("revenue_at_risk").alias("revenue_at_risk"),
    )


def series_delta(series: DataFrame, columns: list[str]) -> DataFrame:
    """Each day's value and its change from the day before (first day: from zero)."""
    order = Window.orderBy("event_date")  # one row per day
    return series.select("event_date", *columns, *[
        (F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0))).alias(f"{c}_delta") for c in columns])


def segment_highlights(mix: DataFrame) -> DataFrame:
    """Per month: segment with the highest churn, and the largest one."""
    label = F.concat_ws(": ", "segment_type", "segment_value")
    return mix.withColumn("_l", label).groupBy("target_month").agg(
        F.max_by("_l", F.struct("churn_rate_pct", "_l")).alias("hottest_segment"),
        F.max("churn_rate_pct").alias("hottest_churn_rate_pct"),
        F.max_by("_l", F.struct("users", "_l")).alias("biggest_segment"),
        F.max("users").alias("biggest_users"),
    )


def behavior_focus(clusters: DataFrame, rows: int = 5) -> DataFrame:
    order = Window.partitionBy("target_month").orderBy(F.col("revenue_at_risk").desc(), F.col("users").desc(), "cluster_label")
    return clusters.withColumn("position", F.row_number().over(order)).where(F.col("position") <= rows).select(
        "target_month", "position", "cluster_label", "users", "revenue_at_risk", "churn_rate_pct")


def renewed_users(trend: DataFrame) -> DataFrame:
    churned = F.least(F.col("total_expiring_users"), F.greatest(F.lit(0), F.col("churned_users")))
    return trend.select("target_month", "total_expiring_users", churned.alias("churned_users"),
                        F.greatest(F.col("total_expiring_users") - churned, F.lit(0)).alias("renewed_users"))
