"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then $BENCH_RUNS times (default 3) into a no-op sink;
the median counts. Queries that read shared stages (snapshot, features, scores) are
timed with the stages present; building them is timed once, on its own.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "transaction_kpi activity_kpi churn_risk_kpi clean_user_logs member_month_snapshot tab1_kpis km_curve segment_mix "
    "model_cohort segment_quadrant sensitivity_1pct month_labels log_month_agg feature_frame tab1_km_artifact payload_cube "
    "score_outputs eval_metrics lever_summary sensitivity_table pulse_daily monte_carlo_runs csv_chunk_scan"
).split()
STAGES = "snapshot scored_cohort month_labels features scored scenario_members monte_carlo_runs".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "").split()

    from pyspark.sql import Observation, functions as F

    from renewlake.operators import montecarlo
    from renewlake.plans import scenarios
    from renewlake.plans.catalog import QUERIES
    from renewlake.plans.stages import read_stage
    from renewlake.session import local_session

    spark = local_session(cpus, "renewlake-bench")

    def once(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def warm_up(df) -> int:
        seen = Observation()
        once(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        return seen.get["rows"]

    stages = {}
    for name in STAGES:
        start = time.perf_counter()
        read_stage(spark, sf_dir, name)
        stages[name] = round(time.perf_counter() - start, 3)

    def build(key: str):
        if key == "monte_carlo_runs":  # the draws themselves, not the stored runs
            return montecarlo.monte_carlo_runs(montecarlo.simulation_units(scenarios.simulated(spark, sf_dir)))
        return QUERIES[key](spark, sf_dir)

    seconds, rows = {}, {}
    names = sorted(QUERIES) if wanted == ["all"] else (wanted or HEADLINE)
    for key in names:
        rows[key] = warm_up(build(key))
        timed = []
        for _ in range(runs):
            start = time.perf_counter()
            once(build(key))
            timed.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(timed), 3)
    print(json.dumps({
        "metric": "headline queries, median of warm runs, planning included",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_out": rows,
        "stage_builds": stages,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
