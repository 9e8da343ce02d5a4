"""Ranks, quantiles, metrics, streams and draws against brute force, with hot values."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewlake.functions import ranks
from renewlake.operators import montecarlo as N, predictive as V, scenario as X
from renewlake.params import MonteCarloConfig, ScenarioConfig
from renewlake.sources.scratch import new_path
from renewlake.streaming import jobs


def values(n, seed=3):
    rng = random.Random(seed)
    return [0.5 if rng.random() < 0.34 else round(rng.random(), 3) for _ in range(n)]


def test_percentile_rank_with_a_hot_value(spark):
    xs = values(2000)
    got = ranks.percentile_rank(spark.createDataFrame([(x,) for x in xs], "x double"), "x", "r").select("x", "r").distinct().collect()
    ordered = sorted(xs)
    for row in got:
        first = ordered.index(row["x"])
        n = ordered.count(row["x"])
        assert row["r"] == pytest.approx((first + (n + 1) / 2) / len(xs))


def test_small_ranks(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.2), ("c", 0.9)], "m string, p double")
    got = {r["m"]: r["r"] for r in ranks.percentile_rank(df, "p", "r").collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 1.0}


@pytest.mark.parametrize("n", [1, 2, 7, 1500])
def test_quantiles(spark, n):
    xs = values(n, seed=n)
    got = ranks.exact_quantiles(spark.createDataFrame([(x,) for x in xs], "x double"), "x", {"a": 0.75, "b": 0.5, "c": 0.0, "d": 1.0}).first()
    assert list(got) == pytest.approx([np.quantile(xs, q) for q in (0.75, 0.5, 0.0, 1.0)])


def test_metrics(spark):
    ps = values(400)
    rng = random.Random(5)
    ys = [int(rng.random() < p) for p in ps]
    got = V.eval_metrics(spark.createDataFrame(list(zip(ps, ys)), "churn_probability double, is_churn int")).first().asDict()
    p = np.clip(np.array(ps), 1e-15, 1 - 1e-15)
    y = np.array(ys)
    assert got["log_loss"] == pytest.approx(float(np.mean(-(y * np.log(p) + (1 - y) * np.log(1 - p)))))
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert got["roc_auc"] == pytest.approx(wins)
    ap, seen = 0.0, 0
    for t in sorted(set(p), reverse=True):
        hits, n = int(y[p >= t].sum()), int((p >= t).sum())
        ap += (hits - seen) / y.sum() * hits / n
        seen = hits
    assert got["pr_auc"] == pytest.approx(ap)


def test_daily_upsert_is_exact_under_batches_and_repeats(spark):
    """Same member in several batches counts once; events delivered again change nothing."""
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=rng.randrange(3 * 24 * 60)), "hot" if rng.random() < 0.4 else f"u{rng.randrange(9)}",
             rng.randrange(50), float(rng.randrange(100))) for i in range(400)]
    schema = "event_id long, ts timestamp, msno string, num_unq int, total_secs double"
    path, out = new_path(spark, "events"), new_path(spark, "upsert")
    for part in (rows[:150], rows[150:300], rows[300:], rows[:150]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.on_time_stream(spark, stream(), out, available_now=True, late=dt.timedelta(days=5)).awaitTermination()
    jobs.on_time_stream(spark, stream(), out, available_now=True, late=dt.timedelta(days=5)).awaitTermination()  # restart
    got = {r["event_date"]: (r["active_users"], r["total_listening_secs"]) for r in jobs.current_daily_kpi(spark, out).collect()}
    want = {}
    for day in {r[1].date() for r in rows}:
        own = [r for r in rows if r[1].date() == day]
        want[day] = (len({r[2] for r in own}), sum(r[4] for r in own))
    assert got == want


def units(spark):
    keys = dict(bi_segment_name="s", risk_band="High", renewal_segment="Pay_Manual", eligible_auto=1, eligible_upsell=0, eligible_engagement=1)
    rows = [{**keys, "price_segment": f"p{i}", "users": 200 + i, "baseline_churn_probability": 0.4, "auto_probability_delta": -0.02,
             "engagement_probability_delta": -0.01, "upsell_probability_delta": 0.0, "expected_renewal_amount": 100.0,
             "upsell_amount_delta": 5.0, "campaign_cost": 1.0} for i in range(12)]
    return spark.createDataFrame(rows)


def test_draws_do_not_depend_on_partitions(spark):
    cfg = MonteCarloConfig(n_iterations=60)
    one = N.monte_carlo_runs(units(spark).coalesce(1), cfg).orderBy("run_id").collect()
    other = N.monte_carlo_runs(units(spark).repartition(7), cfg).orderBy("run_id").collect()
    assert len(one) == 60 and [r["run_id"] for r in one] == list(range(60))
    assert [r["scenario_retained_revenue_30d"] for r in one] == pytest.approx([r["scenario_retained_revenue_30d"] for r in other])
    churn = [r["baseline_churn_prob_pct"] for r in one]
    assert np.mean(churn) == pytest.approx(40, abs=1.5)
    assert N.metric_percentiles(N.monte_carlo_runs(units(spark), cfg)).count() == 8


def test_draws_of_a_unit_are_its_own(spark):
    """Runs of all units are the sums of runs of some and of the rest; further runs change none before."""
    everyone, renewed = units(spark), "baseline_retained_revenue_30d"
    some = F.col("price_segment").isin("p0", "p3", "p4", "p9")
    of = lambda rows, n=130: {
        r["run_id"]: r for r in N.monte_carlo_runs(rows, MonteCarloConfig(n_iterations=n)).collect()}
    whole, part, rest, more = of(everyone), of(everyone.where(some)), of(everyone.where(~some)), of(everyone, 230)
    assert len(whole) == 130 and len(more) == 230
    for run, row in whole.items():
        for column in (renewed, "scenario_retained_revenue_30d", "net_value_after_cost_30d"):
            assert row[column] == pytest.approx(part[run][column] + rest[run][column])
            assert row[column] == pytest.approx(more[run][column])
    assert [whole[i][renewed] for i in range(30)] != [whole[100 + i][renewed] for i in range(30)]  # of two blocks
    alone = [of(everyone.where(F.col("price_segment") == p)) for p in ("p1", "p2")]
    assert [alone[0][i][renewed] for i in range(130)] != [alone[1][i][renewed] for i in range(130)]


def test_invariants_see_broken_runs(spark):
    cfg = MonteCarloConfig(n_iterations=40)
    runs = spark.createDataFrame(N.monte_carlo_runs(units(spark), cfg).collect())
    broken = lambda rows: {r["invariant"]: r["violations"]
                           for r in N.run_invariants(rows, units(spark), cfg).collect() if r["violations"]}
    assert broken(runs) == {}
    one = F.col("run_id") == 7
    spoil = lambda name, value: runs.withColumn(name, F.when(one, value).otherwise(F.col(name)))
    assert broken(spoil("campaign_cost_30d", F.lit(99.0))) == {"campaign_cost": 1, "net_value": 1}
    assert broken(spoil("upsell_risk_multiplier", F.lit(2.0))) == {"multipliers": 1}
    assert broken(spoil("saved_revenue_from_risk_reduction_30d", F.lit(None).cast("double"))) == {"parts_of_revenue": 1}
    assert broken(spoil("run_id", F.lit(8))) == {"run_number": 2, "all_runs": 1}
    assert set(broken(runs.where(~one))) == {"all_runs", "histogram"}


def test_flat_histogram_has_one_bucket(spark):
    df = spark.createDataFrame([(7.0,)] * 5, "net_value_after_cost_30d double")
    got = N.net_value_histogram(df).collect()
    assert [(r["bucket_start"], r["bucket_end"], r["run_count"], r["share_pct"]) for r in got] == [(7.0, 7.0, 5, 100.0)]


def test_a_scenario_without_shares_is_the_baseline(spark, sf):
    from renewlake.plans import scenarios as S

    base = S.base(spark, sf)
    still = X.simulate(base, S.levers(spark, sf), X.config_columns(ScenarioConfig(0.0, 0.0, 0.0)))
    got = still.agg(F.max(F.abs(F.col("simulated_churn_probability") - F.col("baseline_churn_probability"))),
                    F.max(F.abs("total_retained_revenue_delta_30d"))).first()
    assert tuple(got) == (0.0, 0.0)
