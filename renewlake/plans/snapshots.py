"""Member-month snapshot queries (serving taxonomy)."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewlake.functions import buckets as B
from renewlake.functions.cols import month_start
from renewlake.operators import snapshot as M
from renewlake.plans import tables as tb
from renewlake.plans.registry import query
from renewlake.sources import fixtures as fx


@query("snapshot_months")
def _(spark, sf):
    return M.snapshot_months(fx.user_logs(spark, sf), fx.HISTORY_START)


@query("tx_last")
def _(spark, sf):
    return M.tx_last(fx.transactions(spark, sf))


@query("tx_features_history")
def _(spark, sf):
    return M.tx_features_history(fx.transactions(spark, sf), fx.HISTORY_START, fx.REALTIME_START)


@query("log_last")
def _(spark, sf):
    return M.log_last(fx.user_logs(spark, sf))


@query("members_dedup")
def _(spark, sf):
    # Every member twice: the second version moved to the next city.
    people = fx.members(spark, sf)
    versions = people.withColumn("version", F.lit(1)).unionByName(
        people.withColumn("city", F.col("city") + 1).withColumn("version", F.lit(2)))
    return M.members_dedup(versions, fx.transactions(spark, sf), order="version").drop("version")


@query("survival_days")
def _(spark, sf):
    tx = M.tx_last(fx.transactions(spark, sf))
    # Members of one channel have no registration date, so the fallback to the first payment applies.
    known = F.when(F.col("registered_via") != 3, F.col("registration_init_time"))
    people = fx.members(spark, sf).select("msno", known.alias("registration_init_time"))
    days = M.survival_days(F.col("registration_init_time"), F.col("first_tx_date"), F.col("last_expire_date"))
    return tx.join(people, "msno", "left").select("msno", "snapshot_month", days.alias("survival_days"))


@query("behavior_ratios", digits=6)
def _(spark, sf):
    months = fx.transactions(spark, sf).select("msno", month_start("membership_expire_date").alias("snapshot_month")).distinct()
    logs = M.log_last(fx.user_logs(spark, sf))
    return M.add_behavior_ratios(months.join(logs, ["msno", "snapshot_month"], "left")).select(
        "msno", "snapshot_month", "skip_ratio", "discovery_ratio", F.round(F.col("avg_daily_secs") + 1e-7, 4).alias("avg_daily_secs"))


def _bucket_counts(df, column, bucket):
    return df.groupBy(column, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("users"))


@query("bucket_age")
def _(spark, sf):
    return _bucket_counts(fx.members(spark, sf), "bd", B.age_bucket("bd"))


@query("bucket_gender")
def _(spark, sf):
    return _bucket_counts(fx.raw_members(spark, sf), "gender", B.gender_bucket("gender"))


@query("bucket_txn_freq")
def _(spark, sf):
    return _bucket_counts(M.tx_last(fx.transactions(spark, sf)), "tx_count", B.txn_freq_bucket("tx_count"))


@query("bucket_skip")
def _(spark, sf):
    rows = M.add_behavior_ratios(M.log_last(fx.user_logs(spark, sf)))
    return rows.groupBy("snapshot_month", B.skip_bucket("skip_ratio").alias("bucket")).agg(F.count(F.lit(1)).alias("users"))


@query("bucket_price")
def _(spark, sf):
    rows = M.tx_last(fx.transactions(spark, sf))
    return rows.groupBy("snapshot_month", B.price_bucket("avg_price_per_day").alias("bucket")).agg(
        F.count(F.lit(1)).alias("users"), F.min("avg_price_per_day").alias("low"), F.max("avg_price_per_day").alias("high"))


@query("bucket_loyalty")
def _(spark, sf):
    return _bucket_counts(tb.snapshot(spark, sf), "survival_days", B.loyalty_bucket("survival_days"))


@query("bucket_activity")
def _(spark, sf):
    rows = M.add_behavior_ratios(M.log_last(fx.user_logs(spark, sf)))
    return rows.groupBy("snapshot_month", B.activity_bucket("avg_daily_secs").alias("bucket")).agg(F.count(F.lit(1)).alias("users"))


@query("member_month_snapshot", digits=6)
def _(spark, sf):
    return M.member_month_snapshot(
        M.tx_last(fx.transactions(spark, sf)), M.members_dedup(fx.members(spark, sf)),
        M.log_last(fx.user_logs(spark, sf)), "realtime_2017_plus",
    ).drop("processed_at")


@query("snapshot_history_vs_realtime", digits=6)
def _(spark, sf):
    return tb.snapshot(spark, sf).drop("processed_at")
