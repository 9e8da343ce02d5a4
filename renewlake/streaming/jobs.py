"""Streaming jobs: fact and KPI sinks, churn risk, and daily upserts.

Every job takes a stream of (key, value) messages, so a Kafka topic and a folder of
message files are interchangeable. `trigger` defaults to the ten-second cadence;
`available_now` drains what is there and stops.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from renewlake.operators import cleaning, kpis
from renewlake.sources import schemas as S
from renewlake.sources.events import parse
from renewlake.sources.scratch import path_exists
from renewlake.streaming.ledger import DAY, DayLedger

TRIGGER = "10 seconds"


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool,
          mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(_once(handle))
    trigger = {"availableNow": True} if available_now else {"processingTime": TRIGGER}
    return writer.trigger(**trigger).start()


def _once(handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Keep the batch while it is looked at more than once, and skip empty batches."""
    def run(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            if not kept.isEmpty():
                handle(kept, batch_id)
        finally:
            kept.unpersist()

    return run


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch: a batch that runs again replaces its own output."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(path)


def forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """Take the last batch's commit off a stopped stream's checkpoint: it will run again.

    For trials of recovery: this is how a checkpoint looks when the driver was lost after a
    batch had written its output.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [f.getPath().getName() for f in fs.listStatus(folder)]
    last = max((int(n) for n in numbers if n.isdigit()), default=None)
    if last is not None:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, str(last)), False)


REVENUE_PART = T.StructType([*S.KPI_REVENUE.fields[1:5], S.KPI_REVENUE[DAY]])


def _sum_revenue(parts: DataFrame) -> DataFrame:
    names = REVENUE_PART.names
    return parts.groupBy(DAY).agg(*[F.sum(c).alias(c) for c in names if c != DAY]).select(*names)


def transaction_stream(messages: DataFrame, out: str, available_now: bool = False) -> list[StreamingQuery]:
    """Two queries over the transaction topic, each with its own checkpoint: facts, and the revenue KPI.

    A batch adds its part of each day; a version of the day is the sum of all parts so far.
    """
    events = parse(messages, S.TRANSACTIONS)
    ledger = DayLedger(messages.sparkSession, f"{out}/revenue_parts", REVENUE_PART, _sum_revenue, monthly=True)

    def write_facts(batch: DataFrame, batch_id: int) -> None:
        _write_batch(cleaning.prepare_transaction_fact(batch), f"{out}/fact", batch_id)

    def write_kpis(batch: DataFrame, batch_id: int) -> None:
        days = ledger.add(kpis.transaction_kpi(batch), batch_id)
        _write_batch(ledger.read(days).withColumn("processed_at", F.current_timestamp()), f"{out}/kpi", batch_id)

    return [
        start(events, write_facts, f"{out}/checkpoints/fact", available_now),
        start(events, write_kpis, f"{out}/checkpoints/kpi", available_now),
    ]


# --- days that are spread over batches --------------------------------------------------

MEMBER_DAY = T.StructType([
    T.StructField("msno", T.StringType()), T.StructField("secs", T.DoubleType()), T.StructField("unq", T.LongType()),
    T.StructField("rows", T.LongType()), T.StructField(DAY, T.DateType()),
])


def _sum_member_days(parts: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("secs", "unq", "rows")]
    return parts.groupBy(DAY, "msno").agg(*sums).select(*MEMBER_DAY.names)


def member_day_ledger(spark: SparkSession, out: str, merge_after: int = 16) -> DayLedger:
    """Sums per member and day; each batch adds its own part of a day."""
    return DayLedger(spark, f"{out}/member_day", MEMBER_DAY, _sum_member_days, merge_after)


def _member_day_kpi(ledger: DayLedger, kpi: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Handler: add the batch's member-days, then write a new version of each day it touched.

    A day's KPI is computed from all its member-days so far, so it does not matter over how
    many batches a day is spread. A batch that runs again replaces its rows and its version.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        days = ledger.add(kpis.member_days(batch, "date"), batch_id)
        whole = kpi(ledger.read(days)).withColumn("processed_at", F.current_timestamp())
        _write_batch(whole, path, batch_id)

    return handle


def activity_stream(messages: DataFrame, out: str, available_now: bool = False) -> list[StreamingQuery]:
    """Two queries over the log topic: facts, and the activity KPI of every day that a batch touches."""
    spark = messages.sparkSession
    events = parse(messages, S.USER_LOGS)

    def write_facts(batch: DataFrame, batch_id: int) -> None:
        _write_batch(cleaning.prepare_user_log_fact(batch), f"{out}/fact", batch_id)

    write_kpis = _member_day_kpi(member_day_ledger(spark, out), kpis.activity_from_member_days, f"{out}/kpi")
    return [
        start(events, write_facts, f"{out}/checkpoints/fact", available_now),
        start(events, write_kpis, f"{out}/checkpoints/kpi", available_now),
    ]


def churn_risk_stream(
    messages: DataFrame, read_profile: Callable[[], DataFrame], out: str, available_now: bool = False
) -> StreamingQuery:
    """Risk KPI of every day that a batch touches, over the members' totals of the whole day.

    A member is at low activity by the day, not by what one batch brings of it. The profile
    is read again for every batch, so it does not go stale.
    """
    events = parse(messages, S.USER_LOGS)

    def risk(member_days: DataFrame) -> DataFrame:
        logs = member_days.select("msno", F.col(DAY).alias("date"), F.col("secs").alias("total_secs"))
        return kpis.churn_risk_kpi(kpis.churn_risk_features(logs, read_profile()))

    handle = _member_day_kpi(member_day_ledger(messages.sparkSession, out), risk, f"{out}/kpi")
    return start(events, handle, f"{out}/checkpoints/risk", available_now)


def newest_days(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every day's KPI row."""
    return kpis.latest_version(read_batches(spark, path), [DAY], "batch_id").drop("batch_id", "processed_at")


# --- correct daily KPIs under late events and repeated delivery ------------------------

STATE_DAY = T.StructType([*MEMBER_DAY.fields[:-1], T.StructField("events", T.LongType()), MEMBER_DAY[DAY],
                          T.StructField("batch_id", T.LongType())])
EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("msno", T.StringType()),
    T.StructField("num_unq", T.IntegerType()), T.StructField("total_secs", T.DoubleType()), T.StructField(DAY, T.DateType()),
])
LATE = dt.timedelta(days=2)


def _interval(late: dt.timedelta) -> str:
    return f"{int(late.total_seconds())} seconds"


def member_day_state(events: DataFrame, late: dt.timedelta = LATE) -> DataFrame:
    """Running totals per member and day, kept until the watermark passes the day.

    An event id that arrives again within the watermark is counted once. Events later than
    the watermark are not counted here, which bounds the state: `late_event_stream` counts them.
    """
    return (
        events.withWatermark("ts", _interval(late))
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", "1 day").alias("w"), "msno")
        .agg(F.sum("total_secs").alias("secs"), F.sum("num_unq").alias("unq"), F.count("num_unq").alias("rows"),
             F.count(F.lit(1)).alias("events"))
        .select("msno", "secs", "unq", "rows", "events", F.to_date("w.start").alias(DAY))
    )


def current_member_days(spark: SparkSession, table: str) -> DataFrame:
    """Newest version of every member-day."""
    stored = spark.read.schema(STATE_DAY).parquet(table)
    return kpis.latest_version(stored, [DAY, "msno"], "batch_id").drop("batch_id")


def on_time_stream(
    spark: SparkSession, events: DataFrame, out: str, available_now: bool = False, late: dt.timedelta = LATE
) -> StreamingQuery:
    """Changed member-days are written by day and batch; the KPI of the touched days is recomputed.

    Both writes overwrite the folders of their own batch, so a repeated batch changes nothing.
    """
    table, kpi_path = f"{out}/member_day", f"{out}/kpi"

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        (
            changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
            .partitionBy(DAY, "batch_id").parquet(table)
        )
        # At most as many days as the watermark leaves open; as literals they prune the partitions.
        days = [r[DAY] for r in batch.select(DAY).distinct().collect()]
        touched = current_member_days(spark, table).where(F.col(DAY).isin(days))
        _write_batch(kpis.activity_from_member_days(touched), kpi_path, batch_id)

    return start(member_day_state(events, late), write, f"{out}/checkpoints/daily", available_now, mode="update")


def _one_per_event(events: DataFrame) -> DataFrame:
    return events.dropDuplicates([DAY, "event_id"])


def event_ledger(spark: SparkSession, out: str) -> DayLedger:
    """Every event that ever arrived, by day, each id once."""
    return DayLedger(spark, f"{out}/events", EVENT, _one_per_event)


def late_event_stream(
    spark: SparkSession, events: DataFrame, out: str, available_now: bool = False, late: dt.timedelta = LATE
) -> StreamingQuery:
    """The second path: every event goes into the ledger, and days that events came late for are counted from it.

    An event older than all that earlier batches brought, less the delay, is late: it goes
    to the table `late` too, and its day is a late day from then on. Late days that a batch
    touches are recomputed whole, in batch, by pruning to their folders.
    """
    ledger = event_ledger(spark, out)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("event_id", "ts", "msno", "num_unq", "total_secs", F.to_date("ts").alias(DAY))
        days = ledger.add(rows, batch_id, "ts")
        newest = ledger.last_ts_before(batch_id)
        behind = rows.where(F.col("ts") < F.lit(newest - late)) if newest else rows.limit(0)
        _write_batch(behind, f"{out}/late", batch_id)
        known = read_batches(spark, f"{out}/late", _with_batch(EVENT)).where(F.col("batch_id") <= batch_id)
        late_days = {r[DAY] for r in known.select(DAY).distinct().collect()}
        settle(spark, out, [d for d in days if d in late_days], batch_id, 0)

    return start(events, write, f"{out}/checkpoints/late", available_now)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def settle(spark: SparkSession, out: str, days: Sequence[dt.date | None], batch_id: int, step: int) -> None:
    """A version of some days' KPI from all their events; `step` orders versions of one batch."""
    events = event_ledger(spark, out).read(days)
    sums = kpis.member_days(events, DAY)
    counted = events.groupBy(DAY).agg(F.count(F.lit(1)).alias("events")).withColumnRenamed(DAY, "of_day")
    kpi = kpis.activity_from_member_days(sums).join(counted, F.col(DAY).eqNullSafe(F.col("of_day"))).drop("of_day")
    kpi.write.mode("overwrite").parquet(f"{out}/kpi_settled/batch_id={batch_id}/step={step}")


def settled_days(spark: SparkSession, out: str) -> DataFrame:
    """The newest settled version of every late day, with the number of events that it counts."""
    path = f"{out}/kpi_settled"
    schema = T.StructType([*S.KPI_ACTIVITY.fields[:4], T.StructField("events", T.LongType()),
                           T.StructField("batch_id", T.LongType()), T.StructField("step", T.LongType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema).drop("batch_id", "step")
    versions = spark.read.schema(schema).option("basePath", path).parquet(path)
    order = F.struct("batch_id", "step")
    return kpis.latest_version(versions.withColumn("v", order).drop("batch_id", "step"), [DAY], "v").drop("v")


def reconcile(spark: SparkSession, out: str) -> list[dt.date | None]:
    """Settle the days whose counted events are not those in the ledger, and return them.

    The two streams may cut batches at different places, so the state can drop an event
    that the ledger's stream did not take for late. Counts tell: the state holds fewer events
    of that day than the ledger. Run it when both streams have drained their source, or now
    and then; a day settled too early is settled again.
    """
    held = event_ledger(spark, out).read().groupBy(DAY).agg(F.count(F.lit(1)).alias("held"))
    state = current_member_days(spark, f"{out}/member_day").groupBy(DAY).agg(F.sum("events").alias("counted"))
    settled = settled_days(spark, out).select(DAY, "events")
    odd = held.join(state, DAY, "left").join(settled, DAY, "left").where(
        F.col("held") != F.coalesce("events", "counted", F.lit(0)))
    days = [r[DAY] for r in odd.select(DAY).collect()]
    if days:
        last = event_ledger(spark, out).journal().agg(F.max("batch_id")).first()[0]
        path = f"{out}/kpi_settled/batch_id={last}"
        step = 1
        while path_exists(spark, f"{path}/step={step}"):
            step += 1
        settle(spark, out, days, last, step)
    return days


def current_daily_kpi(spark: SparkSession, out: str) -> DataFrame:
    """Every day's KPI: settled days as settled, the others as the state has them."""
    settled = settled_days(spark, out).drop("events")
    on_time = newest_days(spark, f"{out}/kpi")
    return on_time.join(settled, DAY, "left_anti").unionByName(settled)


def reset(spark: SparkSession, out: str, empty: dict[str, T.StructType], realtime_table: str | None = None,
          realtime_source: str = "realtime_2017_plus") -> str:
    """Empty the log fact and its KPI tables, drop realtime snapshot rows, keep all else.

    Returns the run folder to use next: new checkpoints, so the replay starts over.
    """
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/{name}")
    if realtime_table and path_exists(spark, realtime_table):
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{realtime_table}/source={realtime_source}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return f"{out}/run-after-reset"


def append_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append sink that commits each batch once, under its number; empty batches write nothing."""
    return start(stream, lambda batch, batch_id: _write_batch(batch, path, batch_id), checkpoint, available_now)
