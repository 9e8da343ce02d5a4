"""Event messages (key, JSON value): encoding, parsing, replay and the Kafka source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from renewlake.functions.cols import parse_date_iso, parse_float, parse_int, text
from renewlake.sources import schemas as S

EVENT_SCHEMAS = {"members": S.MEMBERS, "transactions": S.TRANSACTIONS, "user_logs": S.USER_LOGS}


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """Unbounded Kafka topic; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )


def message_files(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Stream of message files with the same (key, value) shape as a topic."""
    return spark.readStream.schema(S.KAFKA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def encode(raw: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text rows -> (key, value): typed payload as JSON keyed by member; blank gender -> unknown.

    `keep` carries further columns along, such as the date that orders a replay.
    """
    fields = []
    for f in EVENT_SCHEMAS[table].fields:
        if isinstance(f.dataType, T.IntegerType):
            c = parse_int(f.name)
        elif isinstance(f.dataType, T.DoubleType):
            c = parse_float(f.name)
        elif f.name == "gender":
            c = F.coalesce(F.nullif(text("gender"), F.lit("")), F.lit("unknown"))
        else:
            c = text(f.name)
        fields.append(c.alias(f.name))
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return raw.select(text("msno").alias("key"), value.alias("value"), *keep)


def parse(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """(key, value) -> the payload columns plus kafka_key."""
    payload = F.from_json(F.col("value").cast("string"), schema, {"dateFormat": "yyyy-MM-dd"})
    return messages.select(F.col("key").cast("string").alias("kafka_key"), payload.alias("_p")).select("kafka_key", "_p.*")


def filter_from_start(rows: DataFrame, date_column: str, start: str | None) -> DataFrame:
    """Rows from `start` on. A start that is no ISO date filters nothing; rows whose date is
    no ISO date are kept; blank dates are dropped."""
    day = text(date_column)
    rows = rows.where(day != "")
    iso = parse_date_iso(day)
    start_day = parse_date_iso(F.lit((start or "").strip()))
    return rows.where(start_day.isNull() | iso.isNull() | (iso >= start_day))


def replay_days(rows: DataFrame, date_column: str, start: str | None = None, max_days: int | None = None) -> DataFrame:
    """Rows of the first `max_days` distinct days from `start`, numbered by day.

    Blank members and dates that are not ISO are skipped. Only the distinct days are
    ranked (one row per calendar day); the rows join that short list.
    """
    day = text(date_column)
    dated = rows.withColumn("replay_date", parse_date_iso(day))
    dated = dated.where((text("msno") != "") & F.col("replay_date").isNotNull())
    if start is not None:
        dated = dated.where(F.col("replay_date") >= F.lit(start).cast("date"))
    days = dated.select("replay_date").distinct()
    days = days.withColumn("replay_day", F.row_number().over(Window.orderBy("replay_date")))
    if max_days is not None:
        days = days.where(F.col("replay_day") <= max_days)
    return dated.join(days, "replay_date")


def write_messages(messages: DataFrame, path: str, order_by: str | None = None, files: int | None = None) -> None:
    """Message files, by ranges of a date column if one is given.

    Ranges are cut by the date and, within a date, by a hash of the message: a day with very
    many messages is spread over several files and tasks. Without a date every file gets a
    share of all messages. `files` is their number; left out, the planner's.
    """
    count = [] if files is None else [files]
    salt = F.xxhash64("key", "value")
    by = [order_by, salt] if order_by else [salt]
    dealt = messages.repartitionByRange(*count, *by) if order_by else messages.repartition(*count, *by)
    dealt.select("key", "value").write.mode("overwrite").parquet(path)
