"""Member-month snapshot: one row per member and month of expiry.

Facts are aggregated by (member, month) before any join, so a member that owns a
third of the raw rows reaches the joins as a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from renewlake.functions import buckets as B
from renewlake.functions.cols import clip, month_start, safe_divide
from renewlake.functions.lastrow import last_expiry, last_flag, last_row

PLAYS = ("num_25", "num_50", "num_75", "num_985", "num_100")


def in_window(df: DataFrame, c: str, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(c) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(c) < F.lit(end).cast("date"))
    return df


def snapshot_months(logs: DataFrame, start, date_column: str = "date") -> DataFrame:
    """Months that have listening logs, from the month of `start` on."""
    months = logs.select(month_start(date_column).alias("snapshot_month"))
    return in_window(months, "snapshot_month", start).distinct()


def tx_last(tx: DataFrame, start=None, end=None) -> DataFrame:
    """Last expiry and flags, transaction count, mean list price per day, first payment."""
    price_per_day = F.col("plan_list_price") / F.greatest(F.col("payment_plan_days"), F.lit(1))
    return (
        in_window(tx, "membership_expire_date", start, end)
        .groupBy("msno", month_start("membership_expire_date").alias("snapshot_month"))
        .agg(
            last_row(tx, "is_cancel", "is_auto_renew").alias("_last"),
            F.count(F.lit(1)).alias("tx_count"),
            F.avg(price_per_day).alias("avg_price_per_day"),
            F.min("transaction_date").alias("first_tx_date"),
        )
        .select(
            "msno",
            "snapshot_month",
            last_expiry("_last").alias("last_expire_date"),
            last_flag("_last", 0, 2).alias("churned"),
            last_flag("_last", 1, 2).alias("is_auto_renew"),
            "tx_count",
            "avg_price_per_day",
            "first_tx_date",
        )
    )


def tx_features_history(tx: DataFrame, start=None, end=None) -> DataFrame:
    """Same grain for the history load: zero plan days count as unknown, then the list price stands in."""
    days = F.nullif(F.col("payment_plan_days"), F.lit(0))
    price_per_day = F.coalesce(F.try_divide(F.col("plan_list_price"), days), F.col("plan_list_price"))
    return (
        in_window(tx, "membership_expire_date", start, end)
        .groupBy("msno", month_start("membership_expire_date").alias("snapshot_month"))
        .agg(
            F.count(F.lit(1)).alias("tx_count"),
            F.avg(price_per_day).alias("avg_price_per_day"),
            F.min("transaction_date").alias("first_tx_date"),
            F.max("transaction_date").alias("last_tx_date"),
            last_row(tx, "is_cancel", "is_auto_renew").alias("_latest"),
        )
        .select(
            "msno",
            "snapshot_month",
            last_expiry("_latest").alias("last_expire_date"),
            last_flag("_latest", 0, 2).alias("churned"),
            last_flag("_latest", 1, 2).alias("is_auto_renew"),
            "tx_count",
            "avg_price_per_day",
            "first_tx_date",
            "last_tx_date",
        )
    )


def log_last(logs: DataFrame, start=None, end=None, date_column: str = "date", mean_secs: bool = False) -> DataFrame:
    """Skips, plays, distinct songs, seconds and log days per member and month; on demand the mean seconds of a row."""
    mean = [F.avg("total_secs").alias("mean_secs")] if mean_secs else []
    plays = sum((F.col(c) for c in PLAYS[1:]), F.col(PLAYS[0]))
    return (
        in_window(logs, date_column, start, end)
        .groupBy("msno", month_start(date_column).alias("snapshot_month"))
        .agg(
            F.sum(F.col("num_25") + F.col("num_50")).alias("skip_num"),
            F.sum(plays).alias("play_num"),
            F.sum("num_unq").alias("disc_num"),
            F.sum("total_secs").alias("total_secs"),
            F.count(F.lit(1)).alias("active_days"),
            *mean,
        )
    )


def members_dedup(members: DataFrame, cohort: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """One row per member (last in `order`, by default the largest row), only members of the cohort."""
    if cohort is not None:
        members = members.join(cohort.select("msno").distinct(), "msno", "left_semi")
    rest = [c for c in members.columns if c != "msno"]
    # max_by keeps one row per member in the map-side aggregate; no per-member sort.
    key = F.struct(*([order] if order else []), *rest)
    picked = members.groupBy("msno").agg(F.max_by(F.struct(*rest), key).alias("_row"))
    return picked.select("msno", *[F.col(f"_row.{c}").alias(c) for c in rest])


def survival_days(registration, first_tx, last_expire) -> Column:
    since = F.coalesce(F.datediff(last_expire, registration), F.datediff(last_expire, first_tx), F.lit(0))
    return F.greatest(since, F.lit(0))


def add_behavior_ratios(df: DataFrame) -> DataFrame:
    """Skip and discovery per play, seconds per log day; zero without plays or days."""
    zero = {c: 0 for c in ("skip_num", "play_num", "disc_num", "active_days")}
    df = df.na.fill({**zero, "total_secs": 0.0})

    def ratio(top: str, base: str) -> Column:
        return F.when(F.col(base) > 0, safe_divide(top, base)).otherwise(F.lit(0.0))

    return df.withColumns({
        "skip_ratio": ratio("skip_num", "play_num"),
        "discovery_ratio": ratio("disc_num", "play_num"),
        "avg_daily_secs": ratio("total_secs", "active_days"),
    })


def member_month_snapshot(
    tx_month: DataFrame, members: DataFrame, logs_month: DataFrame, source: str, processed_at: str | None = None
) -> DataFrame:
    """Join the three aggregates (logs on member and month) and assign the serving buckets.

    `members` must hold one row per member. Missing members and logs stay NULL and
    take the written fallbacks. Mean seconds are carried along when the logs hold them.
    """
    carried = ["mean_secs"] if "mean_secs" in logs_month.columns else []
    joined = (
        tx_month.join(members.select("msno", "bd", "gender", "registration_init_time"), "msno", "left")
        .join(logs_month, ["msno", "snapshot_month"], "left")
    )
    stamped = F.lit(processed_at).cast("timestamp") if processed_at else F.current_timestamp()
    return (
        add_behavior_ratios(joined)
        .withColumn("survival_days", survival_days(F.col("registration_init_time"), F.col("first_tx_date"), F.col("last_expire_date")))
        .where(F.col("snapshot_month").isNotNull() & F.col("last_expire_date").isNotNull())
        .select(
            "snapshot_month",
            "msno",
            "last_expire_date",
            clip(F.coalesce(F.col("churned"), F.lit(0)), 0, 1).alias("churned"),
            clip(F.coalesce(F.col("is_auto_renew"), F.lit(0)), 0, 1).alias("is_auto_renew"),
            "survival_days",
            B.age_bucket("bd").alias("age_bucket"),
            B.gender_bucket("gender").alias("gender_bucket"),
            B.txn_freq_bucket("tx_count").alias("txn_freq_bucket"),
            B.skip_bucket("skip_ratio").alias("skip_ratio_bucket"),
            B.price_bucket("avg_price_per_day").alias("price_segment"),
            B.loyalty_bucket("survival_days").alias("loyalty_segment"),
            B.activity_bucket("avg_daily_secs").alias("active_segment"),
            "discovery_ratio",
            "skip_ratio",
            F.lit(source).alias("source"),
            stamped.alias("processed_at"),
            *carried,
        )
    )


def history_and_realtime(
    tx: DataFrame, members: DataFrame, logs: DataFrame, history_start: str, boundary: str,
    stamps: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """History months before the boundary, and later months that have logs, with their mean seconds."""
    people = members_dedup(members)
    log_month = log_last(logs, mean_secs=True)
    history = member_month_snapshot(
        tx_features_history(tx, history_start, boundary).drop("last_tx_date"), people, log_month,
        "history_precompute", stamps[0],
    )
    live_tx = tx_last(tx, boundary).join(snapshot_months(logs, boundary), "snapshot_month", "left_semi")
    live = member_month_snapshot(live_tx, people, log_month, "realtime_2017_plus", stamps[1])
    return history.unionByName(live)
