"""Kaplan-Meier curves for many groups in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def km_input(df: DataFrame, dimensions: Sequence[str], day: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Users per (group, dimension, value, day, event); the dimensions are unpivoted in one scan."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("dimension_value"))
        for d in dimensions
    ]))
    return (
        df.select(*by, pairs.alias("_p"), F.greatest(F.col(day), F.lit(0)).cast("int").alias("day"),
                  F.col(event).cast("int").alias("churned"))
        .groupBy(*by, F.col("_p.dimension").alias("dimension"), F.col("_p.dimension_value").alias("dimension_value"),
                 "day", "churned")
        .agg(F.count(F.lit(1)).alias("users"))
    )


def km_curve(counts: DataFrame, keys: Sequence[str], full_origin: bool = False) -> DataFrame:
    """Product-limit survival per group from (keys, day, churned, users) counts.

    The window runs over days of one group, a few thousand rows at most, however
    many members there are. `full_origin` gives the day-0 point its at_risk and 0 events.
    """
    keys = list(keys)
    days = counts.groupBy(*keys, "day").agg(
        F.sum(F.when(F.col("churned") == 1, F.col("users")).otherwise(F.lit(0))).alias("events"),
        F.sum("users").alias("leaving"),
    )
    later = Window.partitionBy(*keys).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    points = days.withColumn("at_risk", F.sum("leaving").over(later))
    points = points.withColumn("_stay", 1 - F.col("events") / F.col("at_risk"))
    survival = F.when(F.min("_stay").over(so_far) <= 0, F.lit(0.0)).otherwise(
        F.exp(F.sum(F.when(F.col("_stay") > 0, F.log("_stay")).otherwise(F.lit(0.0))).over(so_far))
    )
    # Products that lie on a half come out an ulp to either side of it; the nudge takes all of them up.
    points = points.withColumn("survival_prob", F.round(survival + 1e-10, 6))
    origin = points.groupBy(*keys).agg(F.max("at_risk").alias("at_risk")).select(
        *keys,
        F.lit(0).alias("day"),
        F.lit(1.0).alias("survival_prob"),
        F.when(F.lit(full_origin), F.col("at_risk")).alias("at_risk"),
        F.when(F.lit(full_origin), F.lit(0)).cast("long").alias("events"),
    )
    return origin.unionByName(points.select(*keys, "day", "survival_prob", "at_risk", "events"))
