"""The domain tables as views over the test tables.

Dates fold into 420 days from 2023-01-01, so the months are 202301..202402.
All formulas are per row over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCORE_MONTH = 202402
VALID_MONTH = 202401
FIRST_MONTH = 202301
REALTIME_START = "2023-09-01"
HISTORY_START = "2023-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(c: str) -> Column:
    days = F.datediff(F.to_date(F.col(c)), F.lit("1995-01-01").cast("date"))
    return F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(days, F.lit(420)).cast("int"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    channels = {"AUTOMOBILE": 3, "BUILDING": 4, "FURNITURE": 7, "HOUSEHOLD": 9, "MACHINERY": 13}
    via = F.create_map(*[F.lit(x) for pair in channels.items() for x in pair])
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("msno"),
        (F.col("c_nationkey") + 1).cast("int").alias("city"),
        F.when(key % 97 == 0, 1050).otherwise(key * 7 % 75).cast("int").alias("bd"),
        F.when(key % 3 == 0, "male").when(key % 3 == 1, "female").otherwise("").alias("gender"),
        via[F.col("c_mktsegment")].alias("registered_via"),
        F.date_add(F.lit("2022-01-01").cast("date"), (key * 13 % 700).cast("int")).alias("registration_init_time"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    plan = F.when(k % 13 == 0, 7).when(k % 5 == 4, 90).otherwise(30)
    price = (
        F.when(k % 13 == 0, 0.0).when(k % 5 == 4, 400.0).when(k % 10 == 3, 240.0).when(k % 10 == 1, 99.0)
        .otherwise(149.0)
    )
    paid_on = _fold("o_orderdate")
    length = F.when(k % 11 == 0, k % 10).otherwise(plan).cast("int")
    return table(spark, sf_dir, "orders").select(
        k.alias("rid"),
        F.col("o_custkey").cast("string").alias("msno"),
        (30 + F.col("o_custkey") % 12).cast("int").alias("payment_method_id"),
        plan.cast("int").alias("payment_plan_days"),
        price.alias("plan_list_price"),
        (price * (10 - k % 3) / 10).alias("actual_amount_paid"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM").cast("int").alias("is_auto_renew"),
        paid_on.alias("transaction_date"),
        F.date_add(paid_on, length).alias("membership_expire_date"),
        (k % 11 == 0).cast("int").alias("is_cancel"),
    )


def user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    quantity = F.floor("l_quantity")
    return lines.join(owners, "l_orderkey").select(
        F.col("o_custkey").cast("string").alias("msno"),
        _fold("l_shipdate").alias("date"),
        F.col("l_linenumber").cast("int").alias("num_25"),
        (quantity % 5).cast("int").alias("num_50"),
        (F.col("l_partkey") % 4).cast("int").alias("num_75"),
        (F.col("l_suppkey") % 3).cast("int").alias("num_985"),
        (quantity % 20).cast("int").alias("num_100"),
        (1 + F.col("l_partkey") % 40).cast("int").alias("num_unq"),
        F.when(F.col("l_partkey") % 10 == 0, F.col("l_extendedprice"))
        .otherwise(F.col("l_extendedprice") / 20)
        .alias("total_secs"),
    )


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listening logs as they arrive, with event id and time (cast: stored without zone)."""
    counters = {"num_25": "error", "num_50": "signup", "num_75": "view", "num_985": "click", "num_100": "purchase"}
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("msno"),
        F.to_date("ts").alias("date"),
        *[(F.col("event_type") == kind).cast("int").alias(name) for name, kind in counters.items()],
        F.get_json_object("props", "$.k").try_cast("int").alias("num_unq"),
        (F.col("value") * 60).alias("total_secs"),
    )


# --- dirty text variants -----------------------------------------------------------

def _mixed_date(c: Column, even: Column) -> Column:
    return F.when(even, F.date_format(c, "yyyyMMdd")).otherwise(F.date_format(c, "yyyy-MM-dd"))


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    rid, even = F.col("rid"), F.col("rid") % 2 == 0
    price = F.col("plan_list_price")
    expire = F.when(rid % 61 == 0, F.date_sub("transaction_date", 3)).otherwise(F.col("membership_expire_date"))
    return t.select(
        rid.cast("string").alias("rid"),
        F.when(rid % 50 == 0, F.lit(" ")).otherwise(F.col("msno")).alias("msno"),
        F.col("payment_method_id").cast("string").alias("payment_method_id"),
        F.col("payment_plan_days").cast("string").alias("payment_plan_days"),
        F.when(rid % 53 == 0, F.lit("abc")).when(rid % 59 == 0, F.lit("-1.0")).otherwise(price.cast("string"))
        .alias("plan_list_price"),
        F.col("actual_amount_paid").cast("string").alias("actual_amount_paid"),
        F.concat(F.col("is_auto_renew").cast("string"), F.lit(".0")).alias("is_auto_renew"),
        F.when(rid % 67 == 0, F.lit("2023/01/01")).otherwise(_mixed_date(F.col("transaction_date"), even))
        .alias("transaction_date"),
        _mixed_date(expire, even).alias("membership_expire_date"),
        F.col("is_cancel").cast("string").alias("is_cancel"),
    )


def raw_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    m = members(spark, sf_dir).withColumn("c_custkey", F.col("msno").cast("long"))
    return m.select(
        F.when(key % 50 == 0, F.lit("")).otherwise(F.concat(F.col("msno"), F.lit(" "))).alias("msno"),
        F.col("city").cast("string").alias("city"),
        F.when(key % 41 == 0, F.lit("")).otherwise(F.col("bd").cast("string")).alias("bd"),
        F.when(F.col("gender") == "male", F.lit(" Male")).when(F.col("gender") == "female", F.lit("FEMALE"))
        .otherwise(F.lit("")).alias("gender"),
        F.when(key % 43 == 0, F.lit("x")).otherwise(F.col("registered_via").cast("string")).alias("registered_via"),
        F.when(key % 47 == 0, F.lit("")).otherwise(_mixed_date(F.col("registration_init_time"), key % 4 != 0))
        .alias("registration_init_time"),
    )


def raw_user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = user_logs(spark, sf_dir)
    unq, play = F.col("num_unq"), F.col("num_100")
    even = unq % 2 == 0
    return logs.select(
        F.when((unq == 7) & (play == 3), F.lit("")).otherwise(F.col("msno")).alias("msno"),
        F.when((unq == 9) & (play == 4), F.lit("n/a")).otherwise(_mixed_date(F.col("date"), even)).alias("date"),
        *[F.col(f"num_{n}").cast("string").alias(f"num_{n}") for n in ("25", "50", "75", "985", "100")],
        F.when((unq == 11) & (play == 5), F.lit("-2")).otherwise(unq.cast("string")).alias("num_unq"),
        F.when((unq == 13) & (play == 6), F.lit("abc")).otherwise(F.col("total_secs").cast("string"))
        .alias("total_secs"),
    )


def raw_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    day = F.date_add(F.lit("2023-03-01").cast("date"), (key % 60).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.when(key % 50 == 0, F.lit("")).otherwise(key.cast("string")).alias("msno"),
        F.when(key % 37 == 0, F.lit("9")).when(key % 2 == 0, F.lit("1.0")).otherwise(F.lit("0")).alias("is_churn"),
        F.when(key % 4 == 0, F.lit("")).otherwise(F.date_format(day, "yyyyMMdd")).alias("transaction_date"),
        F.when(key % 8 == 0, F.lit("")).otherwise(F.date_format(F.date_add(day, 1), "yyyy-MM-dd"))
        .alias("membership_expire_date"),
        F.date_format(F.date_add(day, 2), "yyyyMMdd").alias("date"),
    )
