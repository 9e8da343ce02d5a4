"""Label and feature-store queries (batch taxonomy)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from renewlake.operators import features as X, labels as L
from renewlake.plans.registry import query
from renewlake.plans.stages import read_stage, stage
from renewlake.sources import fixtures as fx


@stage("month_labels")
def _labels_stage(spark, sf):
    return L.month_labels(fx.transactions(spark, sf), fx.FIRST_MONTH, fx.SCORE_MONTH)


@stage("features", partition_by=("target_month",), gathered=True)
def _features_stage(spark, sf):
    return X.checked_frame(month_labels(spark, sf), fx.user_logs(spark, sf), fx.members(spark, sf))


def month_labels(spark, sf) -> DataFrame:
    return read_stage(spark, sf, "month_labels")


def features(spark, sf) -> DataFrame:
    return read_stage(spark, sf, "features")


def _days(spark, sf):
    return L.effective_days(L.fix_expiry(fx.transactions(spark, sf)))


def _cohort(spark, sf):
    return L.cohort(_days(spark, sf), fx.FIRST_MONTH, fx.SCORE_MONTH)


@query("same_day_rank")
def _(spark, sf):
    return L.same_day_rank(fx.transactions(spark, sf)).select("msno", "transaction_date", "rid", "day_rank")


@query("effective_tx")
def _(spark, sf):
    return _cohort(spark, sf).select("msno", "target_month", "transaction_date", "expire_date", "rid")


@query("renewal_gap")
def _(spark, sf):
    return _cohort(spark, sf).select("msno", "target_month", "renewal_gap_days")


@query("churn_label")
def _(spark, sf):
    return L.add_label(_cohort(spark, sf)).groupBy("target_month").agg(
        F.count(F.lit(1)).alias("members"), F.sum("is_churn").alias("churned"),
        F.count("renewal_gap_days").alias("renewed_later"))


@query("churn_history")
def _(spark, sf):
    rows = L.add_churn_history(L.add_label(_cohort(spark, sf)))
    return rows.select("msno", "target_month", *[f"last_{k}_is_churn" for k in range(1, 6)],
                       "churn_rate", "churn_count", "transaction_count")


@query("tx_history_aggregates")
def _(spark, sf):
    return L.add_history_aggregates(_cohort(spark, sf)).select(
        "msno", "target_month", *[c for c in L.LABEL_COLUMNS if c.startswith("historical_")])


@query("tx_point_features")
def _(spark, sf):
    return L.add_point_features(_cohort(spark, sf)).select(
        "msno", "target_month", "discount", "is_discount", "amt_per_day", "days_since_previous_transaction")


@query("month_labels")
def _(spark, sf):
    return L.month_labels(fx.transactions(spark, sf), fx.FIRST_MONTH, fx.SCORE_MONTH)


def _log_agg(spark, sf):
    return X.log_month_agg(fx.user_logs(spark, sf), X.required_log_members(month_labels(spark, sf)))


@query("log_month_agg")
def _(spark, sf):
    return _log_agg(spark, sf)


@query("log_cache_coverage")
def _(spark, sf):
    return X.log_coverage(X.required_log_members(month_labels(spark, sf)), X.log_month_agg(fx.user_logs(spark, sf)))


@query("log_features")
def _(spark, sf):
    return X.join_log_features(month_labels(spark, sf).select("msno", "target_month"), _log_agg(spark, sf))


@query("log_secs_cap")
def _(spark, sf):
    return X.cap_seconds(fx.user_logs(spark, sf)).groupBy("date").agg(
        F.sum("capped").alias("capped"), F.max("total_secs").alias("max_secs"), F.sum("total_secs").alias("secs"))


@query("member_encode")
def _(spark, sf):
    return X.encode_members(fx.members(spark, sf))


def _raw(spark, sf):
    return X.raw_frame(month_labels(spark, sf), fx.user_logs(spark, sf), fx.members(spark, sf))


_ADDED = {
    "feat_dates": ("invalid_registration_after_snapshot registration_init_time age has_valid_age transaction_month expire_month "
                   "last_expire_month transaction_day expire_day registration_year registration_month registration_day "
                   "days_to_expire membership_age_days days_since_last_listen tenure_months").split(),
    "feat_price": ("expected_renewal_amount price_gap discount_ratio payment_to_list_ratio price_gap_per_plan_day "
                   "secs_per_paid_amount").split(),
    "feat_listening": ("weighted_completion_sum listen_events_sum skip_events_sum secs_per_log unique_per_log num100_per_log "
                       "weighted_completion_per_log listen_events_per_log avg_secs_per_unique secs_per_plan_day "
                       "uniques_per_plan_day logs_per_plan_day remaining_plan_ratio completion_ratio skip_ratio "
                       "discovery_ratio capped_log_share replay_ratio").split(),
    "feat_churn_recency": "recent_churn_events weighted_recent_churn".split(),
    "feat_flags": ("is_expiring_user is_manual_renew high_skip_flag low_discovery_flag deal_hunter_flag free_trial_flag "
                   "content_fatigue_flag auto_renew_discount_interaction churn_rate_x_transaction_count").split(),
    "rfm_scores": "rfm_recency_score rfm_frequency_score rfm_monetary_score rfm_total_score".split(),
    "segment_codes": [f"{n}_segment_code" for n in ("age", "price", "loyalty", "active", "skip", "discovery", "renewal", "rfm")],
    "segment_labels": [*[f"{n}_segment" for n in ("age", "price", "loyalty", "active", "skip", "discovery", "renewal", "rfm")],
                       "gender", "gender_profile", "bi_segment_name"],
}


def _layer_query(name: str, columns: list[str], depth: int):
    @query(name)
    def _(spark, sf):
        df = _raw(spark, sf)
        for layer in X.LAYERS[:depth]:
            df = layer(df)
        return df.select("msno", "target_month", *columns)


for _i, (_name, _columns) in enumerate(_ADDED.items()):
    _layer_query(_name, _columns, _i + 1)


@query("fillna_numeric")
def _(spark, sf):
    raw = X.feat_dates(_raw(spark, sf))
    return X.fill_numeric(raw).select(
        "msno", "target_month", "bd", "last_log_date", "count", "total_secs_sum", "registration_init_time",
        "membership_age_days", "days_since_last_listen")


@query("feature_frame")
def _(spark, sf):
    return X.feature_frame(month_labels(spark, sf), fx.user_logs(spark, sf), fx.members(spark, sf))


@query("snapshot_validation")
def _(spark, sf):
    return X.snapshot_violations(features(spark, sf))


@query("uniqueness_check")
def _(spark, sf):
    return X.duplicate_members(features(spark, sf))


def _expected(spark, sf):
    """Members expected in the score month: those whose last transaction is not a cancel."""
    tx = fx.transactions(spark, sf)
    last = tx.groupBy("msno").agg(F.max_by("is_cancel", F.struct("transaction_date", "membership_expire_date", "rid")).alias("c"))
    return last.where("c = 0").select("msno")


@query("cohort_alignment")
def _(spark, sf):
    return X.cohort_alignment_report(_expected(spark, sf), X.score_rows(features(spark, sf), fx.SCORE_MONTH))


@query("cohort_aligned_rows")
def _(spark, sf):
    built = X.score_rows(features(spark, sf), fx.SCORE_MONTH).select("msno", "target_month", "transaction_date", "expected_renewal_amount")
    return X.align_to_cohort(_expected(spark, sf), built, fx.SCORE_MONTH)


@query("member_backfill")
def _(spark, sf):
    built = X.score_rows(features(spark, sf), fx.SCORE_MONTH).select("msno", "target_month", "transaction_date", "city", "bd")
    aligned = X.align_to_cohort(_expected(spark, sf), built, fx.SCORE_MONTH)
    return X.backfill_members(aligned, X.encode_members(fx.members(spark, sf)))


@query("model_bi_split")
def _(spark, sf):
    frame = features(spark, sf)
    numeric = X.model_columns(frame)
    bi = X.bi_columns(frame)
    part = F.when(F.col("target_month") < fx.SCORE_MONTH, "train").otherwise("score")
    return frame.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(numeric)).alias("model_columns"), F.lit(len(bi)).alias("bi_columns"),
        F.sum(sum((F.col(c).cast("double") for c in ("age", "rfm_total_score", "days_to_expire")), F.lit(0.0))).alias("checksum"))
