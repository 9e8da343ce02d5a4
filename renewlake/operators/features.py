"""Feature store: listening aggregates, feature layers, checks and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from renewlake import params as P
from renewlake.functions import buckets as B
from renewlake.functions.cols import clip, flag, month_to_date, parse_date_compact, safe_divide, shift_month, yyyymm, yyyymmdd
from renewlake.operators.snapshot import members_dedup

LOG_COLUMNS = ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs")
PLAY_SUMS = ("num_25_sum", "num_50_sum", "num_75_sum", "num_985_sum", "num_100_sum")


# --- members and logs -------------------------------------------------------------

def encode_members(members: DataFrame) -> DataFrame:
    """gender 0/1/2, age only within 15..65, registration as yyyymmdd."""
    return members.select(
        "msno",
        "city",
        F.when(F.col("bd").between(15, 65), F.col("bd")).alias("bd"),
        F.when(F.col("gender") == "male", 1).when(F.col("gender") == "female", 2).otherwise(0).alias("gender"),
        "registered_via",
        yyyymmdd("registration_init_time").alias("registration_init_time"),
    )


def cap_seconds(logs: DataFrame, limit: float = P.MAX_DAILY_SECS) -> DataFrame:
    return logs.withColumn("capped", flag(F.col("total_secs") > limit)).withColumn(
        "total_secs", clip("total_secs", 0.0, limit))


def log_month_agg(logs: DataFrame, required: DataFrame | None = None, months: list[int] | None = None) -> DataFrame:
    """Sums, row count, last date and capped rows per month and member.

    `required` (log_month, msno) keeps the members a month needs; it is applied to
    the aggregate, where one member is one row per month.
    """
    if months:
        logs = logs.where(yyyymm("date").isin(*months))
    agg = (
        cap_seconds(logs)
        .groupBy(yyyymm("date").alias("log_month"), "msno")
        .agg(
            *[F.sum(c).alias(f"{c}_sum") for c in LOG_COLUMNS],
            F.count(F.lit(1)).alias("count"),
            yyyymmdd(F.max("date")).alias("last_log_date"),
            F.sum("capped").alias("capped_log_count"),
        )
    )
    if required is not None:
        agg = agg.join(required.select("log_month", "msno").distinct(), ["log_month", "msno"], "left_semi")
    return agg


def log_coverage(required: DataFrame, built: DataFrame) -> DataFrame:
    """Per month: members required, built, usable, missing and unexpected."""
    r = required.select("log_month", "msno").distinct().withColumn("r", F.lit(1))
    b = built.select("log_month", "msno").withColumn("b", F.lit(1))
    both = r.join(b, ["log_month", "msno"], "full_outer")
    count = lambda c: F.sum(flag(c)).cast("long")
    need, have = F.col("r").isNotNull(), F.col("b").isNotNull()
    return both.groupBy("log_month").agg(
        count(need).alias("required_msnos"),
        count(have).alias("cached_rows"),
        count(need & have).alias("usable_rows"),
        count(need & ~have).alias("missing_required_msnos"),
        count(~need & have).alias("unexpected_cached_msnos"),
    )


def required_log_members(labels: DataFrame) -> DataFrame:
    return labels.select(shift_month("target_month", -1).alias("log_month"), "msno")


def join_log_features(labels: DataFrame, log_agg: DataFrame) -> DataFrame:
    """Previous month's sums and means per row."""
    means = [(F.col(f"{c}_sum") / F.col("count")).alias(f"{c}_mean") for c in LOG_COLUMNS]
    logs = log_agg.select("*", *means).withColumnRenamed("log_month", "_month")
    keyed = labels.withColumn("_month", shift_month("target_month", -1))
    return keyed.join(logs, ["_month", "msno"], "left").drop("_month")


# --- layers ------------------------------------------------------------------------

def _date(c: str) -> Column:
    """yyyymmdd number -> date, NULL for anything that is none."""
    return parse_date_compact(c)


def feat_dates(df: DataFrame) -> DataFrame:
    df = df.withColumn("_snapshot", F.date_sub(month_to_date("target_month"), 1))
    late = flag(_date("registration_init_time") > F.col("_snapshot"))
    df = df.withColumn("invalid_registration_after_snapshot", late).withColumn(
        "registration_init_time",
        F.when(F.col("invalid_registration_after_snapshot") == 0, F.col("registration_init_time")),
    )
    df = df.withColumns({
        "_tx": _date("transaction_date"), "_exp": _date("expire_date"),
        "_reg": _date("registration_init_time"), "_log": _date("last_log_date"),
    })
    age = F.coalesce(F.col("bd"), F.lit(-1)).cast("double")
    membership = F.datediff("_snapshot", "_reg")
    return df.withColumns({
        "age": age,
        "has_valid_age": flag(age >= 0),
        "transaction_month": yyyymm("_tx"),
        "expire_month": yyyymm("_exp"),
        "last_expire_month": yyyymm("_exp"),
        "transaction_day": F.dayofmonth("_tx"),
        "expire_day": F.dayofmonth("_exp"),
        "registration_year": F.year("_reg"),
        "registration_month": F.month("_reg"),
        "registration_day": F.dayofmonth("_reg"),
        "days_to_expire": F.datediff("_exp", "_snapshot"),
        "membership_age_days": membership,
        "days_since_last_listen": F.datediff("_snapshot", "_log"),
        "tenure_months": safe_divide(membership, F.lit(30.0), -1),
    }).drop("_snapshot", "_tx", "_exp", "_reg", "_log")


def feat_price(df: DataFrame) -> DataFrame:
    paid, listed = F.col("actual_amount_paid"), F.col("plan_list_price")
    return df.withColumns({
        "expected_renewal_amount": F.when(paid > 0, paid).otherwise(listed),
        "price_gap": listed - paid,
        "discount_ratio": safe_divide(listed - paid, listed),
        "payment_to_list_ratio": safe_divide(paid, listed),
        "price_gap_per_plan_day": safe_divide(listed - paid, "payment_plan_days"),
        "secs_per_paid_amount": safe_divide("total_secs_sum", paid),
    })


def feat_listening(df: DataFrame) -> DataFrame:
    weights = (0.25, 0.50, 0.75, 0.985, 1.0)
    weighted = sum((F.col(c) * w for c, w in zip(PLAY_SUMS[1:], weights[1:])), F.col(PLAY_SUMS[0]) * weights[0])
    listens = sum((F.col(c) for c in PLAY_SUMS[1:]), F.col(PLAY_SUMS[0]))
    df = df.withColumns({
        "weighted_completion_sum": weighted,
        "listen_events_sum": listens,
        "skip_events_sum": F.col("num_25_sum") + F.col("num_50_sum") + F.col("num_75_sum"),
    })
    quotients = {
        "secs_per_log": ("total_secs_sum", "count"),
        "unique_per_log": ("num_unq_sum", "count"),
        "num100_per_log": ("num_100_sum", "count"),
        "weighted_completion_per_log": ("weighted_completion_sum", "count"),
        "listen_events_per_log": ("listen_events_sum", "count"),
        "avg_secs_per_unique": ("total_secs_sum", "num_unq_sum"),
        "secs_per_plan_day": ("total_secs_sum", "payment_plan_days"),
        "uniques_per_plan_day": ("num_unq_sum", "payment_plan_days"),
        "logs_per_plan_day": ("count", "payment_plan_days"),
        "remaining_plan_ratio": ("days_to_expire", "payment_plan_days"),
        "completion_ratio": ("weighted_completion_sum", "listen_events_sum"),
        "skip_ratio": ("skip_events_sum", "listen_events_sum"),
        "discovery_ratio": ("num_unq_sum", "listen_events_sum"),
        "capped_log_share": ("capped_log_count", "count"),
    }
    df = df.withColumns({name: safe_divide(a, b) for name, (a, b) in quotients.items()})
    return df.withColumn("replay_ratio", clip(1 - F.col("discovery_ratio"), 0.0, 1.0))


def feat_churn_recency(df: DataFrame, lags: int = 5) -> DataFrame:
    past = [F.when(F.col(f"last_{k}_is_churn") == -1, 0).otherwise(F.col(f"last_{k}_is_churn")) for k in range(1, lags + 1)]
    return df.withColumns({
        "recent_churn_events": sum(past[1:], past[0]).cast("double"),
        "weighted_recent_churn": sum((c * (lags - i) for i, c in enumerate(past) if i), past[0] * lags).cast("double"),
    })


def feat_flags(df: DataFrame) -> DataFrame:
    listened = F.col("listen_events_sum") > 0
    skips, habit = F.col("skip_ratio") >= 0.5, F.col("discovery_ratio") < 0.2
    price = F.col("amt_per_day")
    return df.withColumns({
        "is_expiring_user": F.lit(1),
        "is_manual_renew": flag(F.col("is_auto_renew") == 0),
        "high_skip_flag": flag(listened & skips),
        "low_discovery_flag": flag(listened & habit),
        "deal_hunter_flag": flag((price > 0) & (price < 4.5)),
        "free_trial_flag": flag(F.col("expected_renewal_amount") <= 0),
        "content_fatigue_flag": flag(listened & skips & habit),
        "auto_renew_discount_interaction": (F.col("is_auto_renew") * F.col("is_discount")).cast("double"),
        "churn_rate_x_transaction_count": F.col("churn_rate") * F.col("transaction_count"),
    })


def rfm_scores(df: DataFrame) -> DataFrame:
    listened = F.col("listen_events_sum") > 0
    since, logs, money = F.col("days_since_last_listen"), F.col("count"), F.col("expected_renewal_amount")
    df = df.withColumns({
        "rfm_recency_score": B.first_match([(listened & (since <= 7), 3), (listened & (since <= 21), 2), (listened, 1)], 0),
        "rfm_frequency_score": B.first_match([(logs > 15, 3), (logs > 5, 2), (logs > 0, 1)], 0),
        "rfm_monetary_score": B.first_match([(money >= 150, 3), (money >= 100, 2), (money > 0, 1)], 0),
    })
    return df.withColumn(
        "rfm_total_score", F.col("rfm_recency_score") + F.col("rfm_frequency_score") + F.col("rfm_monetary_score"))


def segment_codes(df: DataFrame) -> DataFrame:
    age, price, days, logs = F.col("age"), F.col("amt_per_day"), F.col("membership_age_days"), F.col("count")
    silent = F.col("listen_events_sum") <= 0
    skip, discovery, rfm = F.col("skip_ratio"), F.col("discovery_ratio"), F.col("rfm_total_score")
    m = B.first_match
    return df.withColumns({
        "age_segment_code": m([(age.between(15, 20), 1), (age.between(21, 25), 2), (age.between(26, 35), 3),
                               (age.between(36, 50), 4), (age.between(51, 65), 5)], 0),
        "price_segment_code": m([(price <= 0, 1), (price < 4.5, 2), (price < 6.5, 3), (price >= 6.5, 4)], 0),
        "loyalty_segment_code": m([(days < 0, 0), (days < 30, 1), (days < 180, 2), (days < 365, 3), (days >= 365, 4)], 0),
        "active_segment_code": m([(logs <= 0, 1), (logs <= 5, 2), (logs <= 15, 3), (logs > 15, 4)], 0),
        "skip_segment_code": m([(silent, 0), (skip < 0.2, 1), (skip < 0.5, 2), (skip >= 0.5, 3)], 0),
        "discovery_segment_code": m([(silent, 0), (discovery < 0.2, 1), (discovery < 0.5, 2), (discovery >= 0.5, 3)], 0),
        "renewal_segment_code": m([(F.col("is_auto_renew") == 1, 1), (F.col("is_auto_renew") == 0, 2)], 0),
        "rfm_segment_code": m([(rfm >= 8, 3), (rfm >= 5, 2), (rfm > 0, 1)], 0),
    })


def segment_labels(df: DataFrame) -> DataFrame:
    labels = {
        "age": P.AGE_LABELS, "price": P.PRICE_LABELS, "loyalty": P.LOYALTY_LABELS, "active": P.ACTIVE_LABELS,
        "skip": P.SKIP_LABELS, "discovery": P.DISCOVERY_LABELS, "renewal": P.RENEWAL_LABELS, "rfm": P.RFM_LABELS,
    }
    df = df.withColumn("gender", F.coalesce("gender", F.lit(0)))
    df = df.withColumns({f"{n}_segment": B.numbered_label(f"{n}_segment_code", values) for n, values in labels.items()})
    return df.withColumns({
        "gender_profile": B.numbered_label("gender", P.GENDER_LABELS),
        "bi_segment_name": F.concat_ws(" | ", "loyalty_segment", "renewal_segment", "price_segment", "discovery_segment"),
    })


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fill_numeric(df: DataFrame, value: int = -1) -> DataFrame:
    """NULL, NaN and infinite numbers -> value, every numeric column."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(bad, F.lit(float(value))).otherwise(c).alias(f.name)
        elif isinstance(f.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(value).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)


LAYERS = (feat_dates, feat_price, feat_listening, feat_churn_recency, feat_flags, rfm_scores, segment_codes, segment_labels)


def add_layers(df: DataFrame) -> DataFrame:
    for layer in LAYERS:
        df = layer(df)
    return df


def raw_frame(labels: DataFrame, logs: DataFrame, members: DataFrame) -> DataFrame:
    agg = log_month_agg(logs)
    return join_log_features(labels, agg).join(encode_members(members_dedup(members)), "msno", "left")


def feature_frame(labels: DataFrame, logs: DataFrame, members: DataFrame, gather: bool = False) -> DataFrame:
    """With `gather`, rows of a month come together before the layers, where they are less than half as wide."""
    raw = raw_frame(labels, logs, members)
    return fill_numeric(add_layers(raw.hint("rebalance", F.col("target_month")) if gather else raw))


# --- checks, alignment, splits --------------------------------------------------------

def _violations() -> list[Column]:
    count = lambda c: F.coalesce(F.sum(flag(c)), F.lit(0)).cast("long")
    return [
        count((F.col("last_log_date") > 0) & (F.col("count") > 0) & (F.col("days_since_last_listen") < 0))
        .alias("negative_days_since_last_listen"),
        count((F.col("days_to_expire") < 0) | (F.col("days_to_expire") > 31)).alias("days_to_expire_out_of_range"),
        count((F.col("registration_init_time") > 0) & (F.col("membership_age_days") < 0)).alias("negative_membership_age"),
    ]


def snapshot_violations(frame: DataFrame) -> DataFrame:
    return frame.agg(*_violations())


def checked_frame(labels: DataFrame, logs: DataFrame, members: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The feature frame, and a check to call after it was written: it raises when the frame breaks a rule.

    The counts are gathered while the frame is written, so there is no second scan. Labels
    hold a row for each member and month; with as many rows in the frame no join has
    multiplied or lost any, so its keys are unique too. Rows of a month are gathered, as a
    table with a folder for each month wants them.
    """
    expected, built = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("rows")
    frame = feature_frame(labels.observe(expected, rows), logs, members, gather=True).observe(built, rows, *_violations())

    def check() -> None:
        counts = built.get
        broken = {k: v for k, v in counts.items() if v and k != "rows"}
        if broken:
            raise ValueError(f"feature frame breaks snapshot rules: {broken}")
        if counts["rows"] != expected.get["rows"]:
            raise ValueError(f"feature frame has {counts['rows']} rows for {expected.get['rows']} labels")

    return frame, check


def duplicate_members(frame: DataFrame, keys: tuple[str, ...] = ("msno",)) -> DataFrame:
    copies = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return copies.agg(
        F.count(F.lit(1)).alias("duplicated_keys"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def cohort_alignment_report(expected: DataFrame, built: DataFrame) -> DataFrame:
    e = expected.select("msno").distinct().withColumn("e", F.lit(1))
    b = built.select("msno").distinct().withColumn("b", F.lit(1))
    both = e.join(b, "msno", "full_outer").agg(
        F.count("e").alias("expected_rows"),
        F.count("b").alias("built_rows"),
        F.sum(flag(F.col("b").isNull())).cast("long").alias("missing_from_built"),
        F.sum(flag(F.col("e").isNull())).cast("long").alias("unexpected_in_built"),
    )
    return both.withColumn(
        "exact_match", flag((F.col("missing_from_built") == 0) & (F.col("unexpected_in_built") == 0)))


def align_to_cohort(expected: DataFrame, built: DataFrame, target_month: int) -> DataFrame:
    """Expected members with their features; members without any are flagged."""
    joined = expected.select("msno").join(built, "msno", "left")
    return joined.withColumn("target_month", F.coalesce("target_month", F.lit(target_month))).withColumn(
        "missing_from_built_test", flag(F.col("transaction_date").isNull()))


def backfill_members(aligned: DataFrame, members: DataFrame) -> DataFrame:
    """Member columns from the lookup where NULL, then every numeric NULL -> -1."""
    columns = [c for c in members.columns if c != "msno"]
    lookup = members.select("msno", *[F.col(c).alias(f"_m_{c}") for c in columns])
    joined = aligned.join(lookup, "msno", "left")
    joined = joined.withColumns({
        c: F.coalesce(F.col(c), F.col(f"_m_{c}")) if c in aligned.columns else F.col(f"_m_{c}") for c in columns
    }).drop(*[f"_m_{c}" for c in columns])
    return fill_numeric(joined)


MODEL_KEYS = ("msno", "is_churn", "transaction_date", "expire_date")


def model_columns(frame: DataFrame) -> list[str]:
    return [c for c in numeric_columns(frame) if c not in MODEL_KEYS]


def bi_columns(frame: DataFrame) -> list[str]:
    numeric = set(numeric_columns(frame))
    return [c for c in frame.columns if c not in numeric and c != "msno"]


def train_rows(frame: DataFrame, score_month: int) -> DataFrame:
    return frame.where(F.col("target_month") < score_month)


def score_rows(frame: DataFrame, score_month: int) -> DataFrame:
    return frame.where(F.col("target_month") == score_month).drop("is_churn")
