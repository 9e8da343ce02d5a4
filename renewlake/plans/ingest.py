"""Source, sink, cleaning and streaming queries. File round trips use a new scratch folder per run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F, types as T

from renewlake.functions import cols as C
from renewlake.operators import cleaning as N, kpis as K, labels as L, serving as Q, snapshot as M
from renewlake.plans import tables as tb
from renewlake.plans.registry import query
from renewlake.sources import events as E, files, fixtures as fx, schemas as S
from renewlake.sources.scratch import new_path
from renewlake.streaming import jobs


def _csv(spark, df, name: str) -> str:
    path = new_path(spark, name)
    files.write_csv(df, path)
    return path


# --- scans and sinks ---------------------------------------------------------------

@query("csv_scan")
def _(spark, sf):
    path = _csv(spark, tb.raw_transactions(spark, sf), "raw-transactions")
    return files.read_csv_rows(spark, path, S.RAW_TRANSACTIONS)


@query("csv_scan_typed")
def _(spark, sf):
    path = _csv(spark, fx.members(spark, sf), "members")
    return files.read_csv_typed(spark, path, S.MEMBERS, ["msno", "city", "registration_init_time"])


@query("csv_multi_source")
def _(spark, sf):
    raw = tb.raw_transactions(spark, sf)
    old = _csv(spark, raw.where("is_cancel = '0'"), "transactions-v1")
    new = _csv(spark, raw.where("is_cancel = '1'"), "transactions-v2")
    return files.read_csv_versions(spark, [old, new, f"{old}-absent"], S.RAW_TRANSACTIONS)


@query("csv_chunk_scan")
def _(spark, sf):
    path = _csv(spark, tb.raw_user_logs(spark, sf), "raw-user-logs")
    logs = N.clean_user_logs(files.read_csv_rows(spark, path, S.RAW_USER_LOGS))
    return M.log_last(logs, "2023-01-01", "2023-09-01")


@query("parquet_scan_subset")
def _(spark, sf):
    wanted = {"o_orderkey": F.lit(0), "o_orderstatus": F.lit(""), "channel": F.lit("none"), "o_totalprice": F.lit(0.0)}
    return files.read_parquet_subset(spark, f"{sf}/orders.parquet", wanted)


@query("parquet_sink")
def _(spark, sf):
    path = new_path(spark, "facts")
    files.write_parquet(fx.transactions(spark, sf), path)
    return spark.read.parquet(path)


@query("csv_sink")
def _(spark, sf):
    path = _csv(spark, N.clean_transactions(tb.raw_transactions(spark, sf)).drop("rid"), "clean-transactions")
    back = files.read_csv_typed(spark, path, S.TRANSACTIONS, S.TRANSACTIONS.fieldNames())
    return back.groupBy("transaction_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("actual_amount_paid").alias("paid"), F.sum("is_cancel").alias("cancels"))


@query("batch_append_sink")
def _(spark, sf):
    path = new_path(spark, "appended")
    kpi = K.transaction_kpi(fx.transactions(spark, sf))
    early = kpi.where("event_date < DATE'2023-09-01'")
    files.append_batch(early, path)
    files.append_batch(early.where("total_transactions < 0"), path)
    files.append_batch(kpi.where("event_date >= DATE'2023-09-01'"), path)
    return spark.read.parquet(path)


_LOADED = "2024-03-01 00:00:00"


@query("bulk_load_transactions")
def _(spark, sf):
    facts, _ = N.load_transactions(tb.raw_transactions(spark, sf), _LOADED)
    path = new_path(spark, "fact-transactions")
    files.write_month_partitions(facts, path, "transaction_date")
    return spark.read.parquet(path).drop("processed_at", "yyyymm")


@query("bulk_load_counts")
def _(spark, sf):
    return N.load_transactions(tb.raw_transactions(spark, sf), _LOADED)[1]


@query("bulk_load_members")
def _(spark, sf):
    path = new_path(spark, "dim-members")
    files.write_parquet(N.load_members(fx.raw_members(spark, sf)), path)
    return spark.read.parquet(path)


@query("guarded_rebuild", digits=6)
def _(spark, sf):
    path = new_path(spark, "member-month")
    snap = tb.snapshot(spark, sf)
    history, live = snap.where("source = 'history_precompute'"), snap.where("source = 'realtime_2017_plus'")
    span = (fx.HISTORY_START, fx.REALTIME_START)
    wrong = history.withColumn("survival_days", F.lit(-1))
    steps = [
        files.guarded_rebuild(spark, wrong, path, "history_precompute", *span, force=False),
        files.guarded_rebuild(spark, live, path, "realtime_2017_plus", fx.REALTIME_START, "2025-01-01", force=False),
        files.guarded_rebuild(spark, history, path, "history_precompute", *span, force=False),
        files.guarded_rebuild(spark, history, path, "history_precompute", *span, force=True),
    ]
    done = spark.read.schema(snap.schema).parquet(path).drop("processed_at")
    return done.withColumn("steps", F.lit(",".join(steps)))


@query("month_partitioned_table")
def _(spark, sf):
    path = new_path(spark, "fact-logs")
    files.write_month_partitions(fx.user_logs(spark, sf), path, "date")
    return spark.read.parquet(path).groupBy("yyyymm").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_secs").alias("secs"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("revenue_kpi_rebuild")
def _(spark, sf):
    path = new_path(spark, "kpi-revenue")
    files.write_parquet(K.transaction_kpi(fx.transactions(spark, sf).where("is_cancel = 0")), path)
    files.write_parquet(K.transaction_kpi(fx.transactions(spark, sf)), path)
    return spark.read.parquet(path)


@query("jdbc_scan_pushdown")
def _(spark, sf):
    path = new_path(spark, "fact-for-profile")
    files.write_month_partitions(fx.transactions(spark, sf), path, "transaction_date")
    return K.tx_profile(spark.read.parquet(path))


# --- cleaning ------------------------------------------------------------------------

@query("clean_members")
def _(spark, sf):
    return N.clean_members(fx.raw_members(spark, sf))


@query("clean_transactions")
def _(spark, sf):
    return N.clean_transactions(tb.raw_transactions(spark, sf))


@query("clean_user_logs")
def _(spark, sf):
    return N.clean_user_logs(tb.raw_user_logs(spark, sf))


@query("clean_train")
def _(spark, sf):
    return N.clean_train(fx.raw_train(spark, sf))


@query("parse_date_strict")
def _(spark, sf):
    return fx.raw_members(spark, sf).select(
        "registration_init_time", C.parse_date_compact("registration_init_time").alias("parsed"))


@query("parse_date_flexible")
def _(spark, sf):
    return tb.raw_transactions(spark, sf).select(
        "rid", C.parse_date_flexible("transaction_date").alias("transaction_date"),
        C.parse_date_flexible("membership_expire_date").alias("membership_expire_date"))


@query("parse_int_lenient")
def _(spark, sf):
    return tb.raw_transactions(spark, sf).select(
        "rid", C.parse_int("plan_list_price").alias("list_price"), C.parse_int("actual_amount_paid").alias("paid"),
        C.parse_int("is_auto_renew").alias("auto"))


@query("parse_float_lenient")
def _(spark, sf):
    return tb.raw_user_logs(spark, sf).groupBy("date").agg(
        F.count(C.parse_float("total_secs")).alias("parsed"), F.count(F.lit(1)).alias("rows"),
        F.sum(C.parse_float("total_secs")).alias("secs"))


@query("clean_drop_counts")
def _(spark, sf):
    parts = [
        N.drop_counts("members", N.typed_members(fx.raw_members(spark, sf)), N.valid_members()),
        N.drop_counts("transactions", N.typed_transactions(tb.raw_transactions(spark, sf)), N.valid_transactions()),
        N.drop_counts("user_logs", N.typed_user_logs(tb.raw_user_logs(spark, sf)), N.valid_user_logs()),
        N.drop_counts("train", N.typed_train(fx.raw_train(spark, sf)), N.valid_train()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("member_dimension")
def _(spark, sf):
    path = new_path(spark, "member-dimension")
    files.write_parquet(N.clean_members(fx.raw_members(spark, sf)), path)
    return spark.read.parquet(path)


@query("tx_expiry_fix")
def _(spark, sf):
    return L.fix_expiry(N.typed_transactions(tb.raw_transactions(spark, sf))).select(
        "rid", "transaction_date", "membership_expire_date", "invalid_expire_before_txn", "transaction_month", "expire_month")


@query("prepare_facts")
def _(spark, sf):
    logs = E.parse(E.encode(tb.raw_user_logs(spark, sf), "user_logs"), S.USER_LOGS)
    return N.prepare_user_log_fact(logs).drop("processed_at").groupBy("log_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_secs").alias("secs"), F.sum("num_unq").alias("unq"))


@query("month_arith")
def _(spark, sf):
    months = fx.transactions(spark, sf).select(C.yyyymm("membership_expire_date").alias("m")).distinct()
    return months.select(
        "m", C.month_to_date("m").alias("start"), C.shift_month("m", -1).alias("previous"), C.shift_month("m", 1).alias("next"),
        C.shift_month("m", 14).alias("later"), C.month_label("m").alias("label"), C.days_in_month("m").alias("days"))


@query("safe_divide")
def _(spark, sf):
    tx = fx.transactions(spark, sf)
    return tx.select(
        "rid", C.safe_divide("actual_amount_paid", "plan_list_price").alias("paid_share"),
        C.safe_divide("plan_list_price", F.nullif(F.col("payment_plan_days"), F.lit(7)), -1).alias("per_day"))


# --- events and replay ------------------------------------------------------------------

def _iso_logs(spark, sf):
    """Raw logs whose dates are ISO where they parse, as the cleaned files have them."""
    raw = tb.raw_user_logs(spark, sf)
    return raw.withColumn("date", F.coalesce(F.date_format(C.parse_date_flexible("date"), "yyyy-MM-dd"), "date"))


@query("event_payload_encode")
def _(spark, sf):
    messages = E.encode(fx.raw_members(spark, sf), "members")
    names = ("msno", "city", "bd", "gender", "registered_via", "registration_init_time")
    return messages.select("key", *[F.get_json_object("value", f"$.{n}").alias(n) for n in names])


@query("kafka_json_parse")
def _(spark, sf):
    return E.parse(E.encode(_iso_logs(spark, sf), "user_logs"), S.USER_LOGS).groupBy("kafka_key", "date").agg(
        F.sum("num_unq").alias("unq"), F.sum("total_secs").alias("secs"), F.count(F.lit(1)).alias("rows"))


@query("replay_by_day")
def _(spark, sf):
    days = E.replay_days(_iso_logs(spark, sf), "date", "2023-03-30", 60)
    return days.groupBy("replay_day", "replay_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("msno").alias("members"))


@query("replay_date_filter")
def _(spark, sf):
    raw = tb.raw_transactions(spark, sf)
    valid = E.filter_from_start(raw, "transaction_date", "2023-06-01").withColumn("start", F.lit("2023-06-01"))
    bad = E.filter_from_start(raw, "transaction_date", "2023/06/01").withColumn("start", F.lit("2023/06/01"))
    return valid.unionByName(bad).groupBy("start", F.col("transaction_date").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


def _drain(queries) -> None:
    for q in queries if isinstance(queries, list) else [queries]:
        q.awaitTermination()


FILES = 4  # message files over which every day of a topic is spread


def _messages(rows: DataFrame, table: str, path: str) -> str:
    """Message files of typed rows, each with a share of every day."""
    schema = E.EVENT_SCHEMAS[table]
    dates = {f.name for f in schema.fields if isinstance(f.dataType, T.DateType)}
    fields = [F.date_format(n, "yyyy-MM-dd").alias(n) if n in dates else F.col(n) for n in schema.names]
    E.write_messages(rows.select(F.col("msno").alias("key"), F.to_json(F.struct(*fields)).alias("value")), path, files=FILES)
    return path


def _event_messages(spark, sf, name: str) -> str:
    return _messages(fx.event_logs(spark, sf), "user_logs", new_path(spark, name))


def _run_last_batch_again(spark, run, checkpoint: str) -> None:
    """Take back the last commit, as if the driver had been lost before it, and start the stream anew."""
    jobs.forget_last_commit(spark, checkpoint)
    _drain(run())


@query("kafka_source")
def _(spark, sf):
    """Every message once, although the last batch is written twice."""
    source, out = _event_messages(spark, sf, "topic"), new_path(spark, "topic-copy")
    rows, checkpoint = f"{out}/rows", f"{out}/checkpoint"
    run = lambda: jobs.append_stream(E.message_files(spark, source), rows, checkpoint, available_now=True)
    _drain(run())
    _run_last_batch_again(spark, run, checkpoint)
    return jobs.read_batches(spark, rows).groupBy("key").agg(F.count(F.lit(1)).alias("messages"))


@query("stream_fact_and_kpi")
def _(spark, sf):
    source, out = new_path(spark, "tx-topic"), new_path(spark, "tx-stream")
    raw = N.typed_transactions(tb.raw_transactions(spark, sf).drop("rid")).where(N.valid_transactions())
    text = raw.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("transaction_date", "membership_expire_date")})
    E.write_messages(E.encode(text, "transactions"), source, files=FILES)
    run = lambda: jobs.transaction_stream(E.message_files(spark, source), out, available_now=True)
    _drain(run())
    _run_last_batch_again(spark, run, f"{out}/checkpoints/kpi")
    facts = jobs.read_batches(spark, f"{out}/fact").groupBy(F.col("transaction_date").alias("event_date")).agg(
        F.count(F.lit(1)).alias("fact_rows"))
    kpi = jobs.newest_days(spark, f"{out}/kpi")
    return kpi.join(facts, "event_date", "full_outer")


@query("stream_activity")
def _(spark, sf):
    """Activity of days that are spread over four batches, the last of which runs twice."""
    source, out = _event_messages(spark, sf, "activity-topic"), new_path(spark, "activity-stream")
    run = lambda: jobs.activity_stream(E.message_files(spark, source), out, available_now=True)
    _drain(run())
    for name in ("fact", "kpi"):
        _run_last_batch_again(spark, run, f"{out}/checkpoints/{name}")
    facts = jobs.read_batches(spark, f"{out}/fact").groupBy(F.col("log_date").alias("event_date")).agg(
        F.count(F.lit(1)).alias("fact_rows"))
    return jobs.newest_days(spark, f"{out}/kpi").join(facts, "event_date", "full_outer")


@query("stream_churn_risk")
def _(spark, sf):
    source, out = _event_messages(spark, sf, "log-topic"), new_path(spark, "risk-stream")
    run = lambda: jobs.churn_risk_stream(
        E.message_files(spark, source), lambda: tb.tx_profile(spark, sf), out, available_now=True)
    _drain(run())
    _run_last_batch_again(spark, run, f"{out}/checkpoints/risk")
    return jobs.newest_days(spark, f"{out}/kpi")


@query("stream_daily_upsert")
def _(spark, sf):
    """The event log with the default delay of two days.

    Files come in order of time, then again the first day and a half, and last the events of
    a member in nine from all but the last days, which by then are up to a month late.
    """
    path, out = new_path(spark, "event-files"), new_path(spark, "daily-stream")
    logs = fx.event_logs(spark, sf).select("event_id", "ts", "msno", "num_unq", "total_secs")
    slow = F.pmod(F.xxhash64("msno"), F.lit(9)) == 0
    cut = logs.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    held_back = F.coalesce(slow & (F.col("ts") < F.lit(cut["last"] - dt.timedelta(days=5))), F.lit(False))
    for part in (logs.where(~held_back), logs.where(F.col("ts") < F.lit(cut["first"] + dt.timedelta(hours=36))), logs.where(held_back)):
        part.repartitionByRange(FILES, "ts").write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 2).parquet(path)
    for run in (jobs.on_time_stream, jobs.late_event_stream):
        start = lambda run=run: run(spark, stream(), out, available_now=True)
        _drain(start())
        _run_last_batch_again(spark, start, f"{out}/checkpoints/{'daily' if run is jobs.on_time_stream else 'late'}")
    jobs.reconcile(spark, out)
    return jobs.current_daily_kpi(spark, out)


@query("replay_reset")
def _(spark, sf):
    out, table = new_path(spark, "reset"), new_path(spark, "reset-member-month")
    files.write_parquet(tb.snapshot(spark, sf), table, ("source", "snapshot_month"))
    files.write_parquet(fx.event_logs(spark, sf), f"{out}/fact")
    files.write_parquet(K.transaction_kpi(fx.transactions(spark, sf)), f"{out}/kpi_revenue")
    fact_schema = spark.read.parquet(f"{out}/fact").schema
    jobs.reset(spark, out, {"fact": fact_schema, "kpi_activity": S.KPI_ACTIVITY, "kpi_churn_risk": S.KPI_CHURN_RISK}, table)
    parts = {
        "fact": spark.read.schema(fact_schema).parquet(f"{out}/fact"),
        "kpi_activity": spark.read.schema(S.KPI_ACTIVITY).parquet(f"{out}/kpi_activity"),
        "kpi_churn_risk": spark.read.schema(S.KPI_CHURN_RISK).parquet(f"{out}/kpi_churn_risk"),
        "kpi_revenue": spark.read.parquet(f"{out}/kpi_revenue"),
        "member_month": spark.read.parquet(table),
    }
    result = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        result = one if result is None else result.unionByName(one)
    return result


@query("stable_sample")
def _(spark, sf):
    return Q.stable_sample(tb.snapshot(spark, sf).select("msno").distinct(), 500)
