"""Queries over the snapshot, fact and KPI tables, for all months at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from renewlake import params as P
from renewlake.functions.cols import month_start, upper_median
from renewlake.functions.lastrow import last_expiry, last_flag, last_row


def half_even(c, digits: int):
    """Round on the scaled value, ties to even."""
    scale = float(10 ** digits)
    return F.rint((F.col(c) if isinstance(c, str) else c) * scale) / scale


def segment_filter(df: DataFrame, segment_type: str | None, segment_value: str | None) -> DataFrame:
    """Optional predicate on one segment column; NULL counts as 'Unknown'."""
    if not segment_type and not segment_value:
        return df
    if not segment_type or not segment_value:
        raise ValueError("segment_type and segment_value must be given together")
    if segment_type.strip() not in P.SEGMENT_COLUMNS:
        raise ValueError(f"unknown segment_type: {segment_type}")
    return df.where(F.coalesce(F.col(segment_type.strip()), F.lit("Unknown")) == segment_value.strip())


_KPIS = lambda: [
    F.count(F.lit(1)).alias("total_expiring_users"),
    F.coalesce(F.avg("churned") * 100, F.lit(0.0)).alias("historical_churn_rate"),
    F.coalesce(upper_median("survival_days").cast("double"), F.lit(0.0)).alias("overall_median_survival"),
    F.coalesce(F.avg("is_auto_renew") * 100, F.lit(0.0)).alias("auto_renew_rate"),
]


def tab1_kpis(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("snapshot_month").agg(*_KPIS())


def tab1_kpis_of_month(snapshot: DataFrame, month: str) -> DataFrame:
    """One row, zeros when the month is empty."""
    return snapshot.where(F.col("snapshot_month") == F.lit(month).cast("date")).agg(*_KPIS())


def segment_mix(snapshot: DataFrame) -> DataFrame:
    rows = snapshot.select(
        "snapshot_month",
        "churned",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("t"), F.col(c).alias("v")) for c in P.SEGMENT_COLUMNS
        ])).alias("_s"),
    )
    return rows.groupBy("snapshot_month", F.col("_s.t").alias("segment_type"), F.col("_s.v").alias("segment_value")).agg(
        F.count(F.lit(1)).alias("users"),
        (F.avg("churned") * 100).alias("churn_rate_pct"),
        ((1 - F.avg("churned")) * 100).alias("retain_rate_pct"),
    )


def boredom_scatter(snapshot: DataFrame, rows: int = P.SCATTER_ROWS) -> DataFrame:
    """Largest cells of the discovery x skip grid of each month; grid values break ties."""
    cells = snapshot.groupBy(
        "snapshot_month", half_even("discovery_ratio", 2).alias("discovery_ratio"),
        half_even("skip_ratio", 2).alias("skip_ratio"),
    ).agg(F.count(F.lit(1)).alias("users"), (F.avg("churned") * 100).alias("churn_rate_pct"))
    order = Window.partitionBy("snapshot_month").orderBy(F.col("users").desc(), "discovery_ratio", "skip_ratio")
    return cells.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows).drop("_rank")


def month_options(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.date_format("snapshot_month", "yyyy-MM").alias("month")).distinct()


def month_options_kpi(kpi_tables: list[DataFrame], snapshot: DataFrame, tx: DataFrame) -> DataFrame:
    """Months of the KPI tables; without any KPI row, months of snapshots and last expiries."""
    kpi = None
    for t in kpi_tables:
        months = t.select(month_start("event_date").alias("m"))
        kpi = months if kpi is None else kpi.unionByName(months)
    kpi = kpi.distinct()
    last = tx.groupBy("msno").agg(last_row(tx).alias("_last")).select(last_expiry("_last").alias("e"))
    fallback = (
        snapshot.select(F.col("snapshot_month").alias("m"))
        .unionByName(last.select(month_start("e").alias("m")))
        .distinct()
    )
    # A one-row scalar subquery decides; the fallback side is pruned at run time when KPI rows exist.
    any_kpi = kpi.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kpi.unionByName(fallback.where(any_kpi == 0)).select(F.date_format("m", "yyyy-MM").alias("month"))


def latest_month(tx: DataFrame) -> DataFrame:
    return tx.agg(month_start(F.max("membership_expire_date")).alias("latest_month"))


def _last_in_month(tx: DataFrame) -> DataFrame:
    return tx.groupBy("msno", month_start("membership_expire_date").alias("month_start")).agg(
        last_row(tx, "is_cancel", "is_auto_renew").alias("_last")
    ).select(
        "msno",
        "month_start",
        last_expiry("_last").alias("last_expire_date"),
        last_flag("_last", 0, 2).alias("last_is_cancel"),
        last_flag("_last", 1, 2).alias("last_is_auto_renew"),
    )


def dashboard_metrics(tx: DataFrame) -> DataFrame:
    return _last_in_month(tx).groupBy("month_start").agg(
        F.count(F.lit(1)).alias("total_expiring_users"),
        (F.avg("last_is_cancel") * 100).alias("historical_churn_rate"),
        (F.avg("last_is_auto_renew") * 100).alias("auto_renew_rate"),
    )


def dashboard_survival(tx: DataFrame, members: DataFrame) -> DataFrame:
    """Upper median of days from registration to the last expiry inside the month."""
    joined = _last_in_month(tx).join(members.select("msno", "registration_init_time"), "msno", "left")
    days = F.datediff("last_expire_date", "registration_init_time")
    return joined.withColumn("_days", days).groupBy("month_start").agg(
        upper_median("_days").cast("double").alias("median_survival_days")
    )


def revenue_series(kpi_revenue: DataFrame) -> DataFrame:
    return kpi_revenue.groupBy("event_date").agg(
        F.sum("total_revenue").alias("total_revenue"), F.sum("total_transactions").alias("total_transactions")
    )


def risk_series(kpi_risk: DataFrame) -> DataFrame:
    return kpi_risk.groupBy("event_date").agg(
        F.sum("high_risk_users").alias("high_risk_users"), F.avg("avg_risk_score").alias("avg_risk_score")
    )


def activity_series(kpi_activity: DataFrame) -> DataFrame:
    return kpi_activity.groupBy("event_date").agg(
        F.sum("active_users").alias("active_users"), F.sum("total_listening_secs").alias("total_listening_secs")
    )


def of_month(series: DataFrame, start: str, end: str) -> DataFrame:
    return series.where(
        (F.col("event_date") >= F.lit(start).cast("date")) & (F.col("event_date") < F.lit(end).cast("date"))
    )


def as_of(kpi_tables: list[DataFrame]) -> DataFrame:
    """Newest load time over the KPI tables, the epoch for an empty one."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    newest = None
    for t in kpi_tables:
        one = t.agg(F.coalesce(F.max("processed_at"), epoch).alias("p"))
        newest = one if newest is None else newest.unionByName(one)
    return newest.agg(F.max("p").alias("as_of"))


def snapshot_fallback(snapshot_kpis: DataFrame, fact_metrics: DataFrame, fact_survival: DataFrame) -> DataFrame:
    """Per month: snapshot figures where it has rows, fact figures elsewhere; the median on its own."""
    s = snapshot_kpis.select(
        F.col("snapshot_month").alias("month_start"),
        F.struct("total_expiring_users", "historical_churn_rate", "auto_renew_rate").alias("s"),
        F.col("overall_median_survival").alias("s_median"),
    )
    f = fact_metrics.select(
        "month_start", F.struct("total_expiring_users", "historical_churn_rate", "auto_renew_rate").alias("f")
    )
    joined = f.join(fact_survival, "month_start", "left").join(s, "month_start", "full_outer")
    picked = F.when(F.col("s.total_expiring_users") > 0, F.col("s")).otherwise(F.col("f"))
    return joined.withColumn("p", picked).select(
        "month_start",
        "p.total_expiring_users",
        "p.historical_churn_rate",
        F.when(F.col("s_median") > 0, F.col("s_median")).otherwise(F.coalesce(F.col("median_survival_days"), F.lit(0.0)))
        .alias("median_survival_days"),
        "p.auto_renew_rate",
    )


def stable_sample(df: DataFrame, limit: int | None) -> DataFrame:
    """The `limit` members with the smallest MD5 of their key, the same in every engine; no limit keeps everyone.

    A count per range of hashes (4096 rows) finds the range in which the limit is reached, and
    rows beyond it are filtered out. The sort then sees about `limit` rows, not `limit` rows
    of every input partition.
    """
    if not limit or limit <= 0:
        return df
    key = F.md5("msno")
    bucket = key.substr(1, 3)
    counts = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("c", F.sum("n").over(so_far)).where(F.col("c") >= limit)
    cutoff = F.coalesce(reached.agg(F.min("b").alias("b")).scalar(), F.lit("fff"))
    return df.where(bucket <= cutoff).orderBy(key, "msno").limit(limit)


def model_cohort(
    snapshot: DataFrame, tx: DataFrame, logs: DataFrame | None = None, segment_type: str | None = None,
    segment_value: str | None = None, sample_limit: int | None = None,
) -> DataFrame:
    """Latest snapshot row per member and month with the month's payments and listening.

    Without logs, the listening is the mean seconds that the snapshot carries.
    """
    kept = ("churned", "is_auto_renew", "price_segment", "loyalty_segment", "active_segment", "discovery_ratio", "skip_ratio")
    carried = [] if logs is not None else ["mean_secs"]
    latest = snapshot.groupBy("snapshot_month", "msno").agg(
        F.max_by(F.struct(*kept, *carried), F.struct("processed_at", "source")).alias("_r")
    ).select("snapshot_month", "msno", *[F.col(f"_r.{c}").alias(c) for c in (*kept, *carried)])
    tx_month = tx.groupBy("msno", month_start("membership_expire_date").alias("snapshot_month")).agg(
        F.avg("actual_amount_paid").alias("avg_paid"),
        F.avg(F.greatest(F.col("payment_plan_days"), F.lit(1))).alias("avg_plan_days"),
        F.count(F.lit(1)).cast("double").alias("txn_count"),
    )
    keys = ["msno", "snapshot_month"]
    cohort = segment_filter(latest, segment_type, segment_value).join(tx_month, keys, "left")
    if logs is not None:
        log_month = logs.groupBy("msno", month_start("date").alias("snapshot_month")).agg(
            F.avg("total_secs").alias("mean_secs"))
        cohort = cohort.join(log_month, keys, "left")
    cohort = (
        cohort.select(*keys, *kept, "avg_paid", "avg_plan_days", "txn_count", F.col("mean_secs").alias("avg_daily_secs"))
        .na.fill({"avg_paid": 0.0, "avg_plan_days": 30.0, "txn_count": 1.0, "avg_daily_secs": 0.0})
    )
    return stable_sample(cohort, sample_limit)
