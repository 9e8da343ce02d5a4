"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from renewlake.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0)).alias("x"),
    ).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component_id) for every vertex that has an edge; the id is its smallest vertex.

    Each round replaces a vertex's edges by edges to the smallest vertex it knows, first
    towards larger neighbours and then towards smaller ones, until nothing changes; the
    number of rounds grows with the logarithm of the longest path. A vertex with very many
    edges is met by partial minima and a join that adaptive execution can split. Every round
    is written to the shared folder. Null ends and loops are ignored; no edges, no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(
        edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
        .where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = (both.where("lo > hi").join(least, "hi")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least, "hi").select(F.explode(F.array(
            F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
        )).alias("e")).select("e.hi", "e.lo").where("hi != lo").distinct()
        now = stored(small, "edges")
        new_state = _state(now)
        if new_state == state:
            break
        state = new_state
    found = now.groupBy("hi").agg(F.min("lo").alias("component_id"))
    roots = now.select("lo").distinct().select(F.col("lo").alias("hi"), F.col("lo").alias("component_id"))
    return found.unionAll(roots).groupBy(F.col("hi").alias("vertex")).agg(F.min("component_id").alias("component_id"))
