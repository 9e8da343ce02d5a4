"""Literal cases: expected values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from renewlake.functions import buckets as B, cols as C
from renewlake.operators import descriptive as D, kpis as K, scenario as X, serving as Q, snapshot as M, survival
from renewlake.operators import features as X2, views as W
from renewlake.sources import events as E, files, schemas as S
from renewlake.sources.scratch import new_path


def d(text):
    return dt.date.fromisoformat(text)


def one(df):
    return df.first().asDict()


def test_schemas_name_the_columns():
    assert S.TRANSACTIONS.fieldNames()[0] == "msno" and S.TRANSACTIONS.fieldNames()[-1] == "is_cancel"
    assert S.USER_LOGS.fieldNames() == ["msno", "date", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs"]
    assert not S.MEMBERS["msno"].nullable and len(S.MEMBER_MONTH) == 17


def test_transaction_kpi(spark):
    rows = [("u1", 100.0, 0, 1, d("2017-03-01")), ("u2", 50.0, 1, 0, d("2017-03-01"))]
    tx = spark.createDataFrame(rows, "msno string, actual_amount_paid double, is_cancel int, is_auto_renew int, transaction_date date")
    got = one(K.transaction_kpi(tx))
    assert (got["total_revenue"], got["total_transactions"], got["cancel_count"], got["auto_renew_count"]) == (150.0, 2, 1, 1)


def test_activity_kpi_counts_members_once(spark):
    rows = [("u1", d("2017-03-01"), 60.0, 10), ("u1", d("2017-03-01"), 40.0, 20), ("u2", d("2017-03-01"), 50.0, 30)]
    got = one(K.activity_kpi(spark.createDataFrame(rows, "msno string, date date, total_secs double, num_unq int")))
    assert (got["active_users"], got["total_listening_secs"], got["avg_unique_songs"]) == (2, 150.0, 20.0)


def test_age_and_price_buckets(spark):
    ages = spark.createDataFrame([(18,), (25,), (35,), (50,), (0,), (120,), (None,)], "bd int")
    assert [r[0] for r in ages.select(B.age_bucket("bd")).collect()] == [
        "15_20", "21_30", "31_40", "41_plus", "unknown", "unknown", "unknown"]
    prices = spark.createDataFrame([(3.9,), (6.2,), (12.0,), (None,)], "p double")
    assert [r[0] for r in prices.select(B.price_bucket("p")).collect()] == [
        "deal_<4.5", "standard_4.5_8", "premium_>=8", "deal_<4.5"]


def test_survival_curve(spark):
    rows = [("group_a", 10, 1, 2), ("group_a", 20, 0, 1), ("group_a", 30, 1, 1)]
    counts = spark.createDataFrame(rows, "g string, day int, churned int, users long")
    got = survival.km_curve(counts, ["g"]).orderBy("day").collect()
    assert [(r["day"], r["survival_prob"]) for r in got] == [(0, 1.0), (10, 0.5), (20, 0.5), (30, 0.0)]


def test_segment_filter_needs_both_parts(spark):
    df = spark.createDataFrame([("a", None)], "msno string, price_segment string")
    assert Q.segment_filter(df, None, None).count() == 1
    assert Q.segment_filter(df, "price_segment", "Unknown").count() == 1
    with pytest.raises(ValueError):
        Q.segment_filter(df, "price_segment", None)
    with pytest.raises(ValueError):
        Q.segment_filter(df, "city", "1")


def test_dates(spark):
    df = spark.createDataFrame([("2017-03-01",), ("20170301",), ("2017/03/01",), ("",), (None,), ("20171301",)], "t string")
    got = df.select(C.parse_date_flexible("t").alias("f"), C.parse_date_compact("t").alias("c"), C.parse_date_iso("t").alias("i")).collect()
    day = d("2017-03-01")
    assert [r["f"] for r in got] == [day, day, None, None, None, None]
    assert [r["c"] for r in got] == [None, day, None, None, None, None]
    assert [r["i"] for r in got] == [day, None, None, None, None, None]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("3.9",), ("-3.9",), (" 7 ",), ("abc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(C.parse_int("t")).collect()] == [3, -3, 7, None, None, None]


def test_snapshot_joins_logs_by_month(spark):
    tx = spark.createDataFrame(
        [(d("2017-01-01"), "u1", d("2017-01-31"), 0, 1, 2, 5.0, d("2016-12-15")),
         (d("2017-02-01"), "u1", d("2017-02-28"), 1, 0, 1, 3.5, d("2016-12-15"))],
        "snapshot_month date, msno string, last_expire_date date, churned int, is_auto_renew int, tx_count long, "
        "avg_price_per_day double, first_tx_date date")
    members = spark.createDataFrame([("u1", 25, "male", d("2016-01-01"))], "msno string, bd int, gender string, registration_init_time date")
    logs = spark.createDataFrame(
        [("u1", d("2017-01-01"), 2, 10, 5, 2000.0, 2), ("u1", d("2017-02-01"), 8, 10, 2, 300.0, 1)],
        "msno string, snapshot_month date, skip_num long, play_num long, disc_num long, total_secs double, active_days long")
    got = M.member_month_snapshot(tx, members, logs, "history_precompute").orderBy("snapshot_month").collect()
    assert len(got) == 2
    assert (got[0]["skip_ratio_bucket"], got[0]["active_segment"]) == ("mid_skip", "casual_15m_1h")
    assert (got[1]["skip_ratio_bucket"], got[1]["active_segment"]) == ("high_skip", "inactive_<15m")


def test_history_features_keep_the_month(spark):
    rows = [("u1", 30, 149.0, 149.0, 1, d("2016-12-25"), d("2017-01-05"), 0), ("u1", 30, 149.0, 149.0, 1, d("2017-01-25"), d("2017-02-05"), 1),
            ("u2", 30, 149.0, 149.0, 0, d("2017-01-20"), d("2017-02-18"), 0)]
    tx = spark.createDataFrame(rows, "msno string, payment_plan_days int, plan_list_price double, actual_amount_paid double, "
                                     "is_auto_renew int, transaction_date date, membership_expire_date date, is_cancel int")
    got = M.tx_features_history(tx, "2016-01-01", "2017-03-01").collect()
    assert len(got) == 3 and {str(r["snapshot_month"]) for r in got} == {"2017-01-01", "2017-02-01"}


def test_medians(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    got = one(df.agg(C.upper_median("x").alias("u"), F.percentile("x", 0.5).alias("m")))
    assert (got["u"], got["m"]) == (3, 2.5)


def test_replay_orders_by_day_and_limits_days(spark):
    rows = [("u1", "2017-03-31"), ("u2", "2017-03-30"), ("u3", "2017-03-31"), ("u4", "2017-04-01"), ("u5", "2017-03-29"), ("", "2017-03-30"), ("u6", "n/a")]
    logs = spark.createDataFrame(rows, "msno string, date string")
    got = E.replay_days(logs, "date", "2017-03-30", 2).orderBy("replay_day", "msno").collect()
    assert [(r["msno"], r["replay_day"]) for r in got] == [("u2", 1), ("u1", 2), ("u3", 2)]


def test_replay_filter(spark):
    rows = spark.createDataFrame([("2016-12-31",), ("2017-01-01",), ("2017-01-05",), ("odd",), ("",)], "day string")
    keep = lambda start: [r[0] for r in E.filter_from_start(rows, "day", start).orderBy("day").collect()]
    assert keep("2017-01-01") == ["2017-01-01", "2017-01-05", "odd"]
    assert keep("2017/01/01") == ["2016-12-31", "2017-01-01", "2017-01-05", "odd"]
    assert len(keep(None)) == 4


def test_payload_types(spark):
    raw = spark.createDataFrame([("u1", "1", "30", "", "7", "20170101")], S.RAW_MEMBERS)
    got = one(E.parse(E.encode(raw, "members"), S.MEMBERS).select("kafka_key", "bd", "gender"))
    assert got == {"kafka_key": "u1", "bd": 30, "gender": "unknown"}
    raw = spark.createDataFrame([("u1", "2017-03-01", "1", "0", "0", "0", "4", "10", "90.5")], S.RAW_USER_LOGS)
    got = one(E.parse(E.encode(raw, "user_logs"), S.USER_LOGS))
    assert (got["date"], got["num_unq"], got["total_secs"]) == (d("2017-03-01"), 10, 90.5)


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (1.0,)], "x double")
    got = df.select(B.right_closed_bin("x", D.EDGES, D.ARTIFACT_BINS).alias("r"), B.left_closed_bin("x", D.CLUSTER_EDGES, tuple(D.CLUSTER_BINS)).alias("l")).collect()
    assert [(r["r"], r["l"]) for r in got] == [("0.0-0.2", "0-20%"), ("0.0-0.2", "20-40%"), ("0.8-1.0", "80-100%")]


def test_cohort_alignment(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "msno string")
    built = spark.createDataFrame([("b",), ("c",), ("d",)], "msno string")
    got = one(X2.cohort_alignment_report(expected, built))
    assert (got["missing_from_built"], got["unexpected_in_built"], got["exact_match"]) == (1, 1, 0)


def test_chart_context_takes_the_latest_trend_month(spark):
    trend = spark.createDataFrame([(201703, 100, 10.0)], "target_month int, total_expiring_users long, historical_churn_rate double")
    heat = spark.createDataFrame([(201703, "Free Trial", "At Risk", 5), (201704, "Free Trial", "At Risk", 1)],
                                 "target_month int, value_tier string, risk_segment string, users long")
    got = D.chart_context(trend, heat, 201704).collect()
    assert len(got) == 1 and got[0]["users"] == 5 and (got[0]["churned_users"], got[0]["renewed_users"]) == (10, 90)


def test_scenarios_reject_unknown_and_double_ids(spark):
    catalog = spark.createDataFrame([("balanced-demo", 12800.0)], "scenario_id string, v double")
    assert X.pick_scenario(catalog, None).first()["v"] == 12800.0
    with pytest.raises(ValueError):
        X.pick_scenario(catalog, "no-such")
    with pytest.raises(ValueError):
        X.preset_scenarios((X.P.PRESETS[0], X.P.PRESETS[0]))


def test_guarded_rebuild_and_missing_sources(spark):
    path = new_path(spark, "guard")
    rows = lambda s, m, n: spark.createDataFrame([(f"u{i}", s, d(m)) for i in range(n)], "msno string, source string, snapshot_month date")
    args = ("h", "2017-01-01", "2017-03-01")
    assert files.guarded_rebuild(spark, rows("h", "2017-01-01", 3).union(rows("h", "2017-02-01", 2)), path, *args, force=False) == "written"
    assert files.guarded_rebuild(spark, rows("r", "2017-03-01", 4), path, "r", "2017-03-01", "2018-01-01", force=False) == "rebuilt"
    assert files.guarded_rebuild(spark, rows("h", "2017-01-01", 9), path, *args, force=False) == "skipped"
    assert files.guarded_rebuild(spark, rows("h", "2017-01-01", 1), path, *args, force=True) == "rebuilt"
    got = {(r["source"], str(r["snapshot_month"])): r["count"] for r in spark.read.parquet(path).groupBy("source", "snapshot_month").count().collect()}
    assert got == {("h", "2017-01-01"): 1, ("r", "2017-03-01"): 4}
    with pytest.raises(FileNotFoundError):
        files.read_csv_versions(spark, [path + "-none"], S.RAW_TRAIN)


def test_series_delta(spark):
    df = spark.createDataFrame([(d("2017-03-01"), 5), (d("2017-03-02"), 8)], "event_date date, n int")
    assert [r["n_delta"] for r in W.series_delta(df, ["n"]).orderBy("event_date").collect()] == [5, 3]


def test_merge_series_fills_missing_days(spark):
    revenue = spark.createDataFrame([("2024-01-02", 5.0)], "event_date string, total_revenue double")
    risk = spark.createDataFrame([("2024-01-01", 3)], "event_date string, high_risk_users long")
    activity = spark.createDataFrame([("2024-01-02", 7)], "event_date string, active_users long")
    rows = W.merge_series(revenue, risk, activity).orderBy("event_date").collect()
    assert [tuple(r) for r in rows] == [("2024-01-01", 0.0, 3, 0), ("2024-01-02", 5.0, 0, 7)]
