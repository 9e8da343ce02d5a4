"""Exact ranks and quantiles over a whole table without one-task windows.

The values are first collapsed to (value, count), so a value that holds a third
of all rows is one row here. The distinct values are then cut into ranges at
approximate quantiles (a fixed, small number of split points, the only thing
that reaches the driver); each range is ranked by itself and shifted by the
number of rows in the ranges before it. The split points only balance the work:
any split points give the same, exact answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGES = 256


def _range_of(value: Column, splits: list[float]) -> Column:
    """Number of split points below the value."""
    if not splits:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s < value))


def cumulative_counts(df: DataFrame, value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value: n rows with it, n_before rows with a smaller one.

    `extra` adds further sums per value (name -> column to sum), each with its own
    running total `<name>_before`.
    """
    extra = extra or {}
    sums = {"n": F.count(F.lit(1)), **{name: F.sum(c) for name, c in extra.items()}}
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(*[c.alias(name) for name, c in sums.items()])
    )
    probs = [i / RANGES for i in range(1, RANGES)]
    splits = sorted(set(counts.approxQuantile(value, probs, 0.002)))
    ranged = counts.withColumn("_range", _range_of(F.col(value), splits))

    # At most RANGES rows: the un-partitioned window below is bounded.
    totals = ranged.groupBy("_range").agg(*[F.sum(name).alias(f"_{name}_total") for name in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_{name}_total").over(earlier), F.lit(0)).alias(f"_{name}_offset") for name in sums],
    )
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "_range").select(
        value,
        *sums,
        *[
            (F.col(f"_{name}_offset") + F.coalesce(F.sum(name).over(inside), F.lit(0))).alias(f"{name}_before")
            for name in sums
        ],
    )


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """One row: the linearly interpolated quantiles of `value`, named by the dict keys."""
    ranked = cumulative_counts(df, value)
    last = ranked.agg(F.max(F.col("n_before") + F.col("n") - 1).cast("double").alias("_last"))
    # A one-row scalar subquery; no join is needed to attach it.
    ranked = ranked.withColumn("_last", last.scalar())

    def at(position: Column) -> Column:
        inside = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    aggs = []
    for name, p in probs.items():
        position = F.col("_last") * p
        low, high = at(F.floor(position)), at(F.ceil(position))
        share = F.max(position - F.floor(position))
        aggs.append((low + (high - low) * share).alias(name))
    return ranked.agg(*aggs)


def percentile_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of ties divided by the row count, joined back on the value."""
    ranked = cumulative_counts(df, value)
    total = ranked.agg(F.sum("n").alias("t"))
    ranks = ranked.select(
        F.col(value).alias("_v"),
        ((F.col("n_before") + (F.col("n") + 1) / 2) / total.scalar()).alias(out),
    )
    return df.join(ranks, df[value] == F.col("_v"), "left").drop("_v")
