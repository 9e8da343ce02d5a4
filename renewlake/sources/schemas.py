"""Table schemas of the domain."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str, required: tuple[str, ...] = ()) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "t": T.DateType(),
             "l": T.LongType(), "ts": T.TimestampType()}
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        fields.append(T.StructField(name, kinds[kind], name not in required))
    return T.StructType(fields)


MEMBERS = _struct("msno:s city:i bd:i gender:s registered_via:i registration_init_time:t", ("msno",))
TRANSACTIONS = _struct(
    "msno:s payment_method_id:i payment_plan_days:i plan_list_price:d actual_amount_paid:d "
    "is_auto_renew:i transaction_date:t membership_expire_date:t is_cancel:i",
    ("msno",),
)
USER_LOGS = _struct(
    "msno:s date:t num_25:i num_50:i num_75:i num_985:i num_100:i num_unq:i total_secs:d", ("msno",)
)
TRAIN = _struct("msno:s is_churn:i churn_event_date:t")
KPI_REVENUE = _struct(
    "event_date:t total_revenue:d total_transactions:l cancel_count:l auto_renew_count:l processed_at:ts"
)
KPI_ACTIVITY = _struct("event_date:t active_users:l total_listening_secs:d avg_unique_songs:d processed_at:ts")
KPI_CHURN_RISK = _struct("event_date:t high_risk_users:l avg_risk_score:d processed_at:ts")
MEMBER_MONTH = _struct(
    "snapshot_month:t msno:s last_expire_date:t churned:i is_auto_renew:i survival_days:i age_bucket:s "
    "gender_bucket:s txn_freq_bucket:s skip_ratio_bucket:s price_segment:s loyalty_segment:s active_segment:s "
    "discovery_ratio:d skip_ratio:d source:s processed_at:ts"
)
KAFKA = _struct("key:s value:s")

RAW_TRANSACTIONS = _struct(
    "rid:s msno:s payment_method_id:s payment_plan_days:s plan_list_price:s actual_amount_paid:s "
    "is_auto_renew:s transaction_date:s membership_expire_date:s is_cancel:s"
)
RAW_MEMBERS = _struct("msno:s city:s bd:s gender:s registered_via:s registration_init_time:s")
RAW_USER_LOGS = _struct(
    "msno:s date:s num_25:s num_50:s num_75:s num_985:s num_100:s num_unq:s total_secs:s"
)
RAW_TRAIN = _struct("msno:s is_churn:s transaction_date:s membership_expire_date:s date:s")


def all_strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
