"""Raw text tables -> typed, valid rows. Every cleaner keeps a `valid` variant for drop counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from renewlake.functions.cols import flag, parse_date_compact, parse_date_flexible, parse_float, parse_int, text

TX_INTS = ("payment_method_id", "payment_plan_days", "is_auto_renew", "is_cancel")
TX_FLOATS = ("plan_list_price", "actual_amount_paid")
LOG_INTS = ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")


def _all(conditions: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def _present(*names: str) -> list[Column]:
    return [F.col(n).isNotNull() for n in names]


def typed_members(raw: DataFrame, parse_date=parse_date_compact) -> DataFrame:
    bd = parse_int("bd")
    return raw.select(
        text("msno").alias("msno"),
        parse_int("city").alias("city"),
        F.when(bd > 0, bd).alias("bd"),
        F.coalesce(F.nullif(F.lower(text("gender")), F.lit("")), F.lit("unknown")).alias("gender"),
        parse_int("registered_via").alias("registered_via"),
        parse_date("registration_init_time").alias("registration_init_time"),
    )


def typed_transactions(raw: DataFrame) -> DataFrame:
    keep = [text("rid").try_cast("long").alias("rid")] if "rid" in raw.columns else []
    return raw.select(
        *keep,
        text("msno").alias("msno"),
        parse_int("payment_method_id").alias("payment_method_id"),
        parse_int("payment_plan_days").alias("payment_plan_days"),
        *[parse_float(c).alias(c) for c in TX_FLOATS],
        parse_int("is_auto_renew").alias("is_auto_renew"),
        *[parse_date_flexible(c).alias(c) for c in ("transaction_date", "membership_expire_date")],
        parse_int("is_cancel").alias("is_cancel"),
    )


def typed_user_logs(raw: DataFrame) -> DataFrame:
    return raw.select(
        text("msno").alias("msno"),
        parse_date_flexible("date").alias("date"),
        *[parse_int(c).alias(c) for c in LOG_INTS],
        parse_float("total_secs").alias("total_secs"),
    )


def typed_train(raw: DataFrame) -> DataFrame:
    first = F.coalesce(*[F.nullif(text(c), F.lit("")) for c in ("transaction_date", "membership_expire_date", "date")])
    return raw.select(
        text("msno").alias("msno"),
        parse_int("is_churn").alias("is_churn"),
        parse_date_flexible(first).alias("churn_event_date"),
    )


def valid_members() -> Column:
    return _all([F.col("msno") != "", *_present("registration_init_time")])


def valid_transactions() -> Column:
    return _all([
        F.col("msno") != "",
        *_present("transaction_date", "membership_expire_date", *TX_INTS, *TX_FLOATS),
        F.least("plan_list_price", "actual_amount_paid", F.col("payment_plan_days").cast("double")) >= 0,
    ])


def valid_user_logs() -> Column:
    return _all([F.col("msno") != "", *_present("date", "total_secs", *LOG_INTS), F.least(*LOG_INTS) >= 0,
                 F.col("total_secs") >= 0])


def valid_train() -> Column:
    return _all([F.col("msno") != "", F.col("is_churn").isin(0, 1)])


def clean_members(raw: DataFrame) -> DataFrame:
    return typed_members(raw).where(valid_members())


def clean_transactions(raw: DataFrame) -> DataFrame:
    return typed_transactions(raw).where(valid_transactions())


def clean_user_logs(raw: DataFrame) -> DataFrame:
    return typed_user_logs(raw).where(valid_user_logs())


def clean_train(raw: DataFrame) -> DataFrame:
    return typed_train(raw).where(valid_train())


def drop_counts(name: str, typed: DataFrame, valid: Column) -> DataFrame:
    kept = F.coalesce(F.sum(flag(valid)), F.lit(0)).cast("long")
    return typed.agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("dropped")).select(
        F.lit(name).alias("table"), "kept", "dropped")


def load_transactions(raw: DataFrame, processed_at: str) -> tuple[DataFrame, DataFrame]:
    """Fact rows (NULL numbers -> 0, load time attached) and the inserted/dropped counts."""
    typed = typed_transactions(raw)
    ok = _all([F.col("msno") != "", *_present("transaction_date", "membership_expire_date")])
    facts = typed.where(ok).na.fill(0, [*TX_INTS]).na.fill(0.0, [*TX_FLOATS]).withColumn(
        "processed_at", F.lit(processed_at).cast("timestamp"))
    inserted = F.coalesce(F.sum(flag(ok)), F.lit(0)).cast("long")
    counts = typed.agg(inserted.alias("inserted"), (F.count(F.lit(1)) - inserted).alias("dropped"))
    return facts, counts


def load_members(raw: DataFrame) -> DataFrame:
    """Members dimension; either date format is accepted, age is kept as given."""
    return raw.select(
        text("msno").alias("msno"),
        parse_int("city").alias("city"),
        parse_int("bd").alias("bd"),
        F.coalesce(F.nullif(text("gender"), F.lit("")), F.lit("unknown")).alias("gender"),
        parse_int("registered_via").alias("registered_via"),
        parse_date_flexible("registration_init_time").alias("registration_init_time"),
    ).where(valid_members())


def prepare_transaction_fact(events: DataFrame) -> DataFrame:
    """Flags as 0/1 integers, load time attached, the message key dropped."""
    return events.withColumns({
        "is_auto_renew": F.col("is_auto_renew").cast("int"),
        "is_cancel": F.col("is_cancel").cast("int"),
        "processed_at": F.current_timestamp(),
    }).drop("kafka_key")


def prepare_user_log_fact(events: DataFrame) -> DataFrame:
    return events.withColumnRenamed("date", "log_date").withColumn("processed_at", F.current_timestamp()).drop("kafka_key")
