"""Monte Carlo over simulation units: runs x units as rows, drawn in parallel.

Members are first collapsed to units (groups of equal keys), so the job size is
units x blocks of runs, whatever the number of members. Each unit draws from its own
counter-based stream, keyed by the seed and the unit, with the block of runs as counter: any
partitioning and any retry gives the same numbers, a further unit leaves the draws of the
others alone, and further runs leave those before them alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from renewlake import params as P
from renewlake.params import MonteCarloConfig

CHUNKS = 8
RUNS_PER_BLOCK = 100


def simulation_units(simulated: DataFrame) -> DataFrame:
    """Members with equal keys, NULL keys kept."""
    return simulated.groupBy(*P.SIMULATION_UNIT_KEYS).agg(
        F.count(F.lit(1)).alias("users"),
        *[F.avg(c).alias(c) for c in (
            "baseline_churn_probability", "auto_probability_delta", "engagement_probability_delta",
            "upsell_probability_delta", "expected_renewal_amount", "upsell_amount_delta")],
        F.sum("campaign_cost").alias("campaign_cost"),
        *[F.sum(f"{s}_{w}_30d").alias(f"{s}_{w}_30d")
          for w in ("revenue_at_risk", "retained_revenue") for s in ("baseline", "simulated")],
    )


_DRAWN = ("run_id long, users long, base_renewals double, scenario_renewals double, baseline_revenue double, "
          "price_only_revenue double, scenario_revenue double, campaign_cost double, auto_effect_multiplier double, "
          "engagement_effect_multiplier double, upsell_risk_multiplier double, upsell_amount_multiplier double")

_DRAWN_COLUMNS = [part.split()[0] for part in _DRAWN.split(", ")]


def _block_draws(cfg: MonteCarloConfig):
    """Draws for a block of runs over one chunk of units, as arrays of runs x units.

    The function holds plain numbers only, so that workers need not have this package.
    """
    seed, n_runs, weight = cfg.seed, cfg.n_iterations, max(cfg.beta_concentration, 20.0)
    # Deviation, least and most of the four effect multipliers: auto, engagement, upsell risk, upsell amount.
    effects = np.array([[cfg.auto_effect_std, 0.4, 1.6], [cfg.engagement_effect_std, 0.4, 1.8],
                        [cfg.upsell_risk_std, 0.4, 1.8], [cfg.upsell_amount_std, 0.7, 1.4]])
    per_block, columns = RUNS_PER_BLOCK, list(_DRAWN_COLUMNS)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        units = pdf.sort_values("unit_key")
        column = {c: units[c].to_numpy() for c in units.columns}
        # Every block draws all its runs, also those beyond the last one that is asked for.
        # All units of a run share its multipliers; the renewals are each unit's own.
        strength = np.clip(1.0 + np.random.default_rng([seed, block]).standard_normal((per_block, 4)) * effects[:, 0],
                           effects[:, 1], effects[:, 2])
        risk = np.stack([np.broadcast_to(column["baseline_churn_probability"], (per_block, len(units))), np.clip(
            column["baseline_churn_probability"] + strength[:, :1] * column["auto_probability_delta"]
            + strength[:, 1:2] * column["engagement_probability_delta"]
            + strength[:, 2:3] * column["upsell_probability_delta"], 1e-4, 1 - 1e-4)])
        stay, leave = np.maximum((1.0 - risk) * weight, 1.0), np.maximum(risk * weight, 1.0)
        renewals = np.empty(risk.shape)
        for i, (unit, users) in enumerate(zip(column["unit"].astype(np.uint64), column["users"])):
            own = np.random.Generator(np.random.Philox(
                key=np.array([seed, unit], np.uint64), counter=np.array([0, 0, 0, block], np.uint64)))
            renewals[:, :, i] = own.binomial(users, own.beta(stay[:, :, i], leave[:, :, i]))
        runs = np.arange(block * per_block, min((block + 1) * per_block, n_runs))
        (before, after), strength = renewals[:, : len(runs)], strength[: len(runs)]
        old_pay = column["expected_renewal_amount"]
        new_pay = np.maximum(old_pay + strength[:, 3:] * column["upsell_amount_delta"], 0.0)
        sums = [before.sum(1), after.sum(1), before @ old_pay, (before * new_pay).sum(1), (after * new_pay).sum(1)]
        table = pd.DataFrame(dict(zip(columns[2:7], sums)))
        table[columns[8:]] = strength
        return table.assign(run_id=runs, users=int(column["users"].sum()),
                            campaign_cost=float(column["campaign_cost"].sum()))[columns]

    return draw


def monte_carlo_runs(units: DataFrame, cfg: MonteCarloConfig = MonteCarloConfig()) -> DataFrame:
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in P.SIMULATION_UNIT_KEYS])
    needed = ("users", "baseline_churn_probability", "auto_probability_delta", "engagement_probability_delta",
              "upsell_probability_delta", "expected_renewal_amount", "upsell_amount_delta", "campaign_cost")
    rows = units.select(key.alias("unit_key"), *needed).withColumn("unit", F.xxhash64("unit_key")).withColumn(
        "chunk", F.pmod("unit", F.lit(CHUNKS)))
    last = (cfg.n_iterations - 1) // RUNS_PER_BLOCK
    blocks = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block")
    # The rows are few but costly: keep every partition, which adaptive coalescing would merge.
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select("*", blocks).repartition(tasks, "block", "chunk")
    drawn = spread.groupBy("block", "chunk").applyInPandas(_block_draws(cfg), _DRAWN)
    multipliers = ("auto_effect_multiplier", "engagement_effect_multiplier", "upsell_risk_multiplier", "upsell_amount_multiplier")
    total = F.greatest(F.sum("users"), F.lit(1))
    base, price, after, cost = (F.sum(c) for c in ("baseline_revenue", "price_only_revenue", "scenario_revenue", "campaign_cost"))
    return drawn.groupBy("run_id").agg(
        *[F.max(c).alias(c) for c in multipliers],
        base.alias("baseline_retained_revenue_30d"),
        after.alias("scenario_retained_revenue_30d"),
        (price - base).alias("incremental_upsell_revenue_30d"),
        (after - price).alias("saved_revenue_from_risk_reduction_30d"),
        cost.alias("campaign_cost_30d"),
        (after - base - cost).alias("net_value_after_cost_30d"),
        (100.0 * (1.0 - F.sum("base_renewals") / total)).alias("baseline_churn_prob_pct"),
        (100.0 * (1.0 - F.sum("scenario_renewals") / total)).alias("scenario_churn_prob_pct"),
    )


def metric_percentiles(runs: DataFrame) -> DataFrame:
    """Mean, population deviation and five percentiles of the eight metrics over the runs."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(label).alias("metric"), F.lit(c).alias("column"), F.col(c).alias("x"))
        for c, label in P.MONTE_CARLO_METRICS.items()
    ]))
    return runs.select(rows.alias("r")).groupBy("r.metric", "r.column").agg(
        F.avg("r.x").alias("mean"),
        F.stddev_pop("r.x").alias("std"),
        *[F.percentile("r.x", q / 100).alias(f"p{q:02d}") for q in (5, 25, 50, 75, 95)],
    )


def win_probabilities(runs: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return runs.agg(
        F.count(F.lit(1)).alias("n_iterations"),
        share(F.col("scenario_retained_revenue_30d") > F.col("baseline_retained_revenue_30d"))
        .alias("probability_scenario_beats_baseline"),
        share(F.col("net_value_after_cost_30d") > 0).alias("probability_net_positive"),
    )


def run_invariants(runs: DataFrame, units: DataFrame, cfg: MonteCarloConfig = MonteCarloConfig()) -> DataFrame:
    """(invariant, checked, violations): what must hold of any draws, one row each.

    Of the runs: numbers 0 to n - 1, each once; the parts of the revenue add up to the whole;
    multipliers and percentages lie in their ranges; all runs cost what the units cost; no run
    earns more than if every user renewed. Of the summaries: percentiles rise, the mean lies
    between the extremes, the histogram holds every run once.
    """
    full = units.agg(
        F.sum("campaign_cost").alias("cost"), F.sum(F.col("users") * F.col("expected_renewal_amount")).alias("most"),
        F.sum(F.col("users") * F.greatest(  # upsell amounts grow with the largest multiplier, or shrink with the least
            F.col("expected_renewal_amount") + 1.4 * F.col("upsell_amount_delta"),
            F.col("expected_renewal_amount") + 0.7 * F.col("upsell_amount_delta"), F.lit(0.0))).alias("most_after"))
    limits = full.select(F.struct("cost", "most", "most_after").alias("u")).scalar()
    c, u = F.col, F.col("u")
    near = lambda x, y: F.abs(x - y) <= 1e-9 * (1 + F.abs(x) + F.abs(y))
    within = lambda name, low, high: c(name).between(low, high)
    old, new = c("baseline_retained_revenue_30d"), c("scenario_retained_revenue_30d")
    parts = c("incremental_upsell_revenue_30d") + c("saved_revenue_from_risk_reduction_30d")
    rules = {
        "run_number": within("run_id", 0, cfg.n_iterations - 1) & (c("times") == 1),
        "parts_of_revenue": F.abs(new - old - parts) <= 1e-9 * (1 + old + new),
        "net_value": F.abs(c("net_value_after_cost_30d") - (new - old - c("campaign_cost_30d"))) <= 1e-9 * (1 + old + new),
        "campaign_cost": near(c("campaign_cost_30d"), u["cost"]),
        "multipliers": within("auto_effect_multiplier", 0.4, 1.6) & within("engagement_effect_multiplier", 0.4, 1.8)
        & within("upsell_risk_multiplier", 0.4, 1.8) & within("upsell_amount_multiplier", 0.7, 1.4),
        "percentages": within("baseline_churn_prob_pct", 0, 100) & within("scenario_churn_prob_pct", 0, 100),
        "full_renewal": (old >= 0) & (new >= 0) & (old <= u["most"] * (1 + 1e-9)) & (new <= u["most_after"] * (1 + 1e-9)),
    }
    times = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("times"))
    tested = runs.join(times, "run_id").withColumn("u", limits)

    def counted(rows: DataFrame, checks: dict) -> DataFrame:
        broken = [F.struct(F.lit(name).alias("invariant"), F.count(F.lit(1)).alias("checked"),
                           F.count_if(~F.coalesce(rule, F.lit(False))).alias("violations"))
                  for name, rule in checks.items()]
        return rows.agg(F.array(*broken).alias("found")).select(F.inline("found"))

    extremes = runs.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("column"), c(name).alias("x")) for name in P.MONTE_CARLO_METRICS])).alias("r")
    ).groupBy("r.column").agg(F.min("r.x").alias("low"), F.max("r.x").alias("high"))
    steps = ["low", "p05", "p25", "p50", "p75", "p95", "high"]
    rising = F.lit(True)
    for below, above in zip(steps, steps[1:]):
        rising = rising & (c(below) <= c(above))
    slack = 1e-9 * (1 + F.abs("low") + F.abs("high"))
    summaries = counted(metric_percentiles(runs).join(extremes, "column"), {
        "percentiles": rising,
        "mean_and_deviation": c("mean").between(c("low") - slack, c("high") + slack)
        & c("std").between(0, (c("high") - c("low")) / 2 + slack)})
    bins = net_value_histogram(runs).agg(F.sum("run_count").alias("n"), F.sum("share_pct").alias("pct"))
    whole = counted(bins, {"histogram": (c("n") == cfg.n_iterations) & near(c("pct"), F.lit(100.0))})
    missing = counted(runs.agg(F.count_distinct("run_id").alias("n")), {"all_runs": c("n") == cfg.n_iterations})
    return counted(tested, rules).unionByName(summaries).unionByName(whole).unionByName(missing)


def net_value_histogram(runs: DataFrame, column: str = "net_value_after_cost_30d") -> DataFrame:
    """Equal-width bins over the runs, the last one closed; one bin when all runs agree."""
    values = runs.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    span = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).alias("s"))
    s = span.where("s.n > 0").withColumns({
        "flat": F.abs(F.col("s.hi") - F.col("s.lo")) <= 1e-8 + 1e-5 * F.abs(F.col("s.hi")),
        "bins": F.least(F.greatest(F.floor(F.sqrt("s.n")), F.lit(10)), F.lit(20)).cast("int"),
    }).withColumn("bins", F.when(F.col("flat"), F.lit(1)).otherwise(F.col("bins")))
    s = s.withColumn("step", (F.col("s.hi") - F.col("s.lo")) / F.col("bins"))
    one = s.select(F.struct("s.lo", "s.hi", "s.n", "bins", "step", "flat").alias("r")).scalar()
    hits = values.withColumn("r", one).select(
        F.when(F.col("r.flat"), F.lit(0)).otherwise(
            F.least(F.floor((F.col("x") - F.col("r.lo")) / F.col("r.step")).cast("int"), F.col("r.bins") - 1)).alias("bin")
    ).groupBy("bin").agg(F.count(F.lit(1)).alias("run_count"))
    dense = s.select("s.lo", "s.hi", "s.n", "step", "flat", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    start = F.col("lo") + F.col("bin") * F.col("step")
    end = F.when(F.col("flat"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("step"))
    return dense.join(hits, "bin", "left").na.fill({"run_count": 0}).select(
        "bin", start.alias("bucket_start"), end.alias("bucket_end"),
        F.when(F.col("flat"), start).otherwise((start + end) / 2).alias("bucket_mid"),
        "run_count", (F.col("run_count") / F.col("n") * 100).alias("share_pct"))
