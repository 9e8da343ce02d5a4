"""Streams whose days are spread over batches, whose batches run again and whose events come late."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from renewlake.functions.cols import parse_date_iso
from renewlake.operators import kpis
from renewlake.sources import events as E, schemas as S
from renewlake.sources.scratch import new_path
from renewlake.streaming import jobs
from renewlake.streaming.ledger import DayLedger

DAY0 = dt.date(2024, 1, 30)


def log_rows(n=600, seed=3):
    """A hot member, a day that is the month's last, missing values."""
    rnd = random.Random(seed)
    return [dict(msno="hot" if rnd.random() < 0.35 else f"u{rnd.randrange(12)}", date=str(DAY0 + dt.timedelta(days=rnd.randrange(4))),
                 num_25=1, num_50=0, num_75=0, num_985=None, num_100=2, num_unq=rnd.choice([None, 1, 5]),
                 total_secs=rnd.choice([None, 100.0, 500.0])) for _ in range(n)]


def topic(spark, rows, files=5):
    path = new_path(spark, "topic")
    messages = spark.createDataFrame([(r["msno"], json.dumps(r)) for r in rows], S.KAFKA)
    E.write_messages(messages, path, files=files)
    return path


def drain(queries):
    for q in queries if isinstance(queries, list) else [queries]:
        q.awaitTermination()


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def typed(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.USER_LOGS.fields if f.name != "date")
                                 + ", date string").withColumn("date", F.col("date").cast("date"))


@pytest.mark.parametrize("merge_after", [2, 16])
def test_activity_of_split_days(spark, monkeypatch, merge_after):
    """Distinct members and means over days that five batches share; the last batch runs twice."""
    monkeypatch.setattr(jobs.member_day_ledger, "__defaults__", (merge_after,))
    rows = log_rows()
    source, out = topic(spark, rows), new_path(spark, "activity")
    run = lambda: jobs.activity_stream(E.message_files(spark, source), out, available_now=True)
    drain(run())
    ledger = jobs.member_day_ledger(spark, out)
    spread = {r["event_date"]: r["n"] for r in ledger.journal().groupBy("event_date").agg(F.count_distinct("batch_id").alias("n")).collect()}
    assert len(spread) == 4 and min(spread.values()) >= 3
    assert (ledger.bases().count() > 0) == (merge_after == 2)
    want = rows_of(kpis.activity_kpi(typed(spark, rows)))
    assert rows_of(jobs.newest_days(spark, f"{out}/kpi")) == want
    for name in ("fact", "kpi"):
        jobs.forget_last_commit(spark, f"{out}/checkpoints/{name}")
    drain(run())
    assert rows_of(jobs.newest_days(spark, f"{out}/kpi")) == want
    assert jobs.read_batches(spark, f"{out}/fact").count() == len(rows)


def test_risk_is_judged_by_the_day(spark):
    """Each batch alone would see members below the limit who are above it over the whole day."""
    rows = log_rows(seed=8)
    source, out = topic(spark, rows), new_path(spark, "risk")
    profile = spark.createDataFrame([("hot", 0.0, 0.0), ("u1", 1.0, 0.0), ("u2", 1.0, 1.0)],
                                    "msno string, is_cancel double, is_auto_renew double")
    run = lambda: jobs.churn_risk_stream(E.message_files(spark, source), lambda: profile, out, available_now=True)
    drain(run())
    jobs.forget_last_commit(spark, f"{out}/checkpoints/risk")
    drain(run())
    whole = kpis.churn_risk_kpi(kpis.churn_risk_features(typed(spark, rows), profile))
    got = rows_of(jobs.newest_days(spark, f"{out}/kpi"))
    assert got == rows_of(whole) and sum(r[-1] for r in got) > 0
    first = jobs.read_batches(spark, f"{out}/kpi").where("batch_id = 0").drop("batch_id", "processed_at")
    assert rows_of(first) != got


def test_append_commits_a_batch_once(spark):
    source, out = topic(spark, log_rows(60)), new_path(spark, "copy")
    run = lambda: jobs.append_stream(E.message_files(spark, source), f"{out}/rows", f"{out}/c", available_now=True)
    drain(run())
    for _ in range(2):
        jobs.forget_last_commit(spark, f"{out}/c")
        drain(run())
    assert jobs.read_batches(spark, f"{out}/rows").count() == 60


def test_no_file_holds_a_hot_day(spark):
    """Ranges of the replay are cut inside a day: of a day with most messages no file has more than its share."""
    days = [DAY0] * 900 + [DAY0 + dt.timedelta(days=1 + i % 9) for i in range(100)]
    rows = spark.createDataFrame([(f"m{i}", str(i), d) for i, d in enumerate(days)], "key string, value string, replay_date date")
    path = new_path(spark, "days")
    E.write_messages(rows, path, order_by="replay_date", files=8)
    files = spark.read.parquet(path).withColumn("file", F.input_file_name()).join(rows, ["key", "value"])
    sizes = [r["count"] for r in files.groupBy("file").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 300
    spans = sorted((r["a"], r["z"]) for r in files.groupBy("file").agg(F.min("replay_date").alias("a"), F.max("replay_date").alias("z")).collect())
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert rows.where(parse_date_iso("replay_date").isNull()).count() == 0


EVENTS = "event_id long, ts timestamp, msno string, num_unq int, total_secs double"


def write_events(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def daily(rows):
    """Users, seconds and mean songs of each day, each event id once."""
    out = {}
    for i, ts, msno, unq, secs in {r[0]: r for r in rows}.values():
        out.setdefault(ts.date(), []).append((msno, unq, secs))
    mean = lambda xs: round(sum(xs) / len(xs), 9) if xs else None
    return {d: (len({m for m, *_ in v}), sum(s for *_, s in v), mean([u for _, u, _ in v if u is not None])) for d, v in out.items()}


def drawn_events(rnd, first, n, start, span):
    return [(first + i, start + dt.timedelta(seconds=rnd.randrange(span)), rnd.choice(["a", "b", "c", "hot", "hot"]),
             rnd.choice([None, 2, 3]), float(rnd.randrange(50))) for i in range(n)]


def test_late_events_are_not_lost(spark):
    """Events far behind the watermark, repeats of them, and on-time events of a day that was late before."""
    rnd, day = random.Random(1), 24 * 3600
    t0 = dt.datetime(2024, 3, 1)
    at = lambda d: t0 + dt.timedelta(days=d)
    parts = [drawn_events(rnd, 0, 80, at(0), 3 * day), drawn_events(rnd, 100, 80, at(3), 4 * day),
             drawn_events(rnd, 200, 60, at(6), 3 * day),
             drawn_events(rnd, 300, 40, at(0), 8 * day),  # up to nine days late, the youngest on time
             drawn_events(rnd, 400, 40, at(7), 3 * day)]
    parts.append(parts[0][:30] + parts[3][:10] + drawn_events(rnd, 500, 10, at(1), day))
    path, out = new_path(spark, "events"), new_path(spark, "daily")
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    seen = []
    for part in parts:  # files as they arrive, both streams started anew each time
        write_events(spark, path, part)
        seen += part
        if len(seen) not in (220, 260, sum(map(len, parts))):
            continue
        for run in (jobs.on_time_stream, jobs.late_event_stream):
            drain(run(spark, stream(), out, available_now=True))
        jobs.reconcile(spark, out)
        got = {r["event_date"]: (r["active_users"], r["total_listening_secs"], round(r["avg_unique_songs"], 9))
               for r in jobs.current_daily_kpi(spark, out).collect()}
        assert got == daily(seen)
    state = jobs.current_member_days(spark, f"{out}/member_day").agg(F.sum("events")).first()[0]
    assert state < len({r[0] for r in seen})  # the state did drop events
    assert jobs.read_batches(spark, f"{out}/late").count() > 0
    jobs.forget_last_commit(spark, f"{out}/checkpoints/late")
    drain(jobs.late_event_stream(spark, stream(), out, available_now=True))
    assert jobs.reconcile(spark, out) == []


def test_streams_that_cut_batches_elsewhere(spark):
    """The state takes one file a batch, the ledger all files at once: it sees no late event, counts tell."""
    rnd, day = random.Random(5), 24 * 3600
    t0 = dt.datetime(2024, 3, 1)
    parts = [drawn_events(rnd, 0, 30, t0, day), drawn_events(rnd, 100, 30, t0 + dt.timedelta(days=9), day),
             drawn_events(rnd, 300, 30, t0 + dt.timedelta(days=9), day), drawn_events(rnd, 200, 30, t0, 5 * day)]
    path, out = new_path(spark, "events"), new_path(spark, "daily")
    for part in parts:
        write_events(spark, path, part)
    stream = lambda n: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", n).parquet(path)
    drain(jobs.on_time_stream(spark, stream(1), out, available_now=True))
    drain(jobs.late_event_stream(spark, stream(9), out, available_now=True))
    assert jobs.read_batches(spark, f"{out}/late").count() == 0
    assert jobs.reconcile(spark, out) and jobs.reconcile(spark, out) == []
    got = {r["event_date"]: r["active_users"] for r in jobs.current_daily_kpi(spark, out).collect()}
    assert got == {d: v[0] for d, v in daily(sum(parts, [])).items()}


@pytest.mark.parametrize("monthly", [False, True])
def test_ledger_reads_the_same_before_and_after_merging(spark, monthly):
    """Random batches, rows without a day, merges at any time, a batch that runs again with other tasks."""
    rnd = random.Random(monthly)
    summed = lambda df: df.groupBy("event_date", "k").agg(F.sum("v").alias("v")).select("k", "v", "event_date")
    schema = spark.createDataFrame([], "k string, v long, event_date date").schema
    ledger = DayLedger(spark, new_path(spark, "ledger"), schema, summed, 3, monthly)
    assert ledger.read().collect() == [] and ledger.merge_days(5) == []
    want = {}
    for batch in range(5):
        days = [None, *(DAY0 + dt.timedelta(days=i) for i in range(3))]
        rows = [(rnd.choice("xy"), rnd.randrange(9), rnd.choice(days)) for _ in range(12)]
        for k, v, d in rows:
            want[d, k] = want.get((d, k), 0) + v
        for again in range(1 + batch % 2):
            touched = ledger.add(spark.createDataFrame(rows, schema).repartition(again + 1), batch)
        assert set(touched) == {r[2] for r in rows}
        assert {(r.event_date, r.k): r.v for r in ledger.read().collect()} == want
        some = [DAY0, None]
        assert {(r.event_date, r.k): r.v for r in ledger.read(some).collect()} == {x: v for x, v in want.items() if x[0] in some}
    assert ledger.bases().count() == 4 and ledger.merge_days(4, least=1)
    assert {(r.event_date, r.k): r.v for r in ledger.read().collect()} == want
