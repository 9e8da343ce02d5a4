"""Exact top-k search by inner product: norm-sorted vectors, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from renewlake.llm.common import prepared, shuffle_parts, stored

SEEDS = 1024  # longest vectors that give every query its first threshold
BLOCK_ROWS = 16_384  # vectors of a block
QUERY_ROWS = 2_048  # queries of a block
STEP_ROWS = 2_048  # vectors between two rises of the thresholds
EXACT = 2.0 ** 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # what a score of 64 bits can hold


def gram_matrix(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of v v' over all vectors, summed in the tasks first: dim * dim numbers."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                total += v.T @ v
        yield pa.RecordBatch.from_pydict({"at": np.arange(dim * dim, dtype=np.int32), "x": total.ravel()})

    sums = vectors.select("vec").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(dim * dim)
    total[sums["at"].to_numpy()] = sums["x"].to_numpy()
    return total.reshape(dim, dim)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats while every sum is below 2^53, else by Python integers.

    Sums beyond 64 bits become the nearest number that 64 bits hold.
    """
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    sums = queries.astype(object) @ vectors.astype(object).T
    return np.minimum(np.maximum(sums, LEAST), MOST).astype(np.int64)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or the least integer if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), LEAST)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _reachable(floors: np.ndarray) -> np.ndarray:
    """Thresholds as floats; the least integer stands for any sum at or below it, so nothing is too small for it."""
    return np.where(floors == LEAST, -np.inf, floors.astype(np.float64))


def _search(k: int, rotation: np.ndarray, head: int):
    """Of one block of vectors and one of queries: up to k candidates a query that can still be among its best."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asks"].to_numpy()
        members = block[~asks].sort_values(["norm", "vec_id"], ascending=[False, True])
        queries = block[asks]
        if not len(members) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        v, q = np.stack(members["vec"].to_numpy()), np.stack(queries["vec"].to_numpy())
        v_id, q_id = members["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        v_norm, q_norm = members["norm"].to_numpy(), queries["norm"].to_numpy()
        v_turned, q_turned = v @ rotation, q @ rotation
        v_rest = np.sqrt(np.maximum(v_norm ** 2 - (v_turned[:, :head] ** 2).sum(1), 0))
        q_rest = np.sqrt(np.maximum(q_norm ** 2 - (q_turned[:, :head] ** 2).sum(1), 0))
        floor = _reachable(queries["floor"].to_numpy())
        best_score = [np.empty(0, np.int64)] * len(q)
        best_id = [np.empty(0, np.int64)] * len(q)
        for at in range(0, len(v), STEP_ROWS):
            slack = 1e-9 * (1 + q_norm * v_norm[at])  # far above what rounding can lose
            live = np.flatnonzero(q_norm * v_norm[at] + slack >= floor)  # later vectors are no longer
            if not len(live):
                break
            part = slice(at, at + STEP_ROWS)
            bound = q_turned[live, :head] @ v_turned[part, :head].T + np.outer(q_rest[live], v_rest[part])
            can = bound + slack[live, None] >= floor[live, None]
            columns = np.flatnonzero(can.any(0))
            if not len(columns):
                continue
            scores = _products(q[live], v[part][columns])
            ids = v_id[part][columns]
            for row, i in enumerate(live):
                mine = can[row, columns] & (ids != q_id[i])
                s, d = np.append(best_score[i], scores[row, mine]), np.append(best_id[i], ids[mine])
                order = np.lexsort((d, ~s))[:k]  # ~s falls as s rises, and has no overflow
                best_score[i], best_id[i] = s[order], d[order]
                if len(order) == k:
                    floor[i] = max(floor[i], _reachable(s[order[-1:]])[0])
        return pd.DataFrame({
            "query_id": np.repeat(q_id, [len(x) for x in best_id]),
            "vec_id": np.concatenate(best_id), "score": np.concatenate(best_score)})

    return run


def _with_floors(k: int, seeds: list):
    """A lower bound of each query's k-th score: its k-th best among the longest vectors."""
    ids = np.array([s["vec_id"] for s in seeds], np.int64)
    longest = np.array([s["vec"] for s in seeds], np.int64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.array(batch.column(1).to_pylist(), np.int64)
            scores = _products(q, longest)
            own = batch.column(0).to_numpy()[:, None] == ids[None, :]
            scores[own] = LEAST
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_kth(scores, k), pa.int64())], names=["vec_id", "vec", "norm", "floor"])

    return run


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products with the other vectors.

    `vectors` has (vec_id long, vec array<long>), one row per id; `is_query` is a condition on
    vec_id. Ties go to the smaller vec_id. Exact: the vectors are dealt to blocks by falling
    length, and a query starts with the k-th score it has among the longest ones. It isn't sent
    to blocks whose length cannot reach that (Cauchy-Schwarz). Within a block, vectors come by
    falling length; the products of the leading coordinates, rotated by the singular vectors
    of all data, plus the product of the residual lengths bound the score; what is left is
    computed in integers. A block of equal lengths is split by hash, so many copies don't
    make a large block.

    Defined cases: null vectors take no part; vectors of unlike length aren't compared; fewer
    than k other vectors give fewer rows; no queries or an empty table give no rows; a sum
    beyond 64 bits counts as the largest or least number of 64 bits, and such are ties.
    """
    spark = prepared(vectors.sparkSession)
    rows = stored(vectors.where("vec is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<long>").alias("vec"),
        F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm")), "topk-vectors")
    found = None
    for dim in sorted(r[0] for r in rows.select(F.size("vec")).distinct().collect()):
        part = _top_of(spark, rows.where(F.size("vec") == dim), is_query, k, dim)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _top_of(spark, rows: DataFrame, is_query: Column, k: int, dim: int) -> DataFrame:
    _, turned = np.linalg.eigh(gram_matrix(rows, dim))
    rotation = np.ascontiguousarray(turned[:, ::-1])
    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "vec").collect()

    # Bands of falling length, each cut into blocks of bounded size.
    n_bands = max(4, min(64, shuffle_parts(spark)))
    cuts = rows.agg(F.percentile_approx("norm", [i / n_bands for i in range(1, n_bands)], 1000).alias("c")).first()["c"]
    band = F.lit(0)
    for i, cut in enumerate(sorted(set(cuts or [])), 1):
        band = F.when(F.col("norm") > cut, F.lit(-i)).otherwise(band)
    banded = rows.withColumn("band", band)
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy("band").collect()
    first, pieces, blocks = {}, {}, 0
    for s in sizes:
        first[s["band"]], pieces[s["band"]] = blocks, -(-s["n"] // BLOCK_ROWS)
        blocks += pieces[s["band"]]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("band"))
    count = F.element_at(F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv]), F.col("band"))
    members = banded.withColumn("block", start + F.pmod(F.xxhash64("vec_id"), count).cast("int"))

    queries = rows.where(is_query).mapInArrow(
        _with_floors(k, seeds), "vec_id long, vec array<long>, norm double, floor long")
    queries = stored(queries, "topk-queries")
    n_parts = max(1, -(-queries.count() // QUERY_ROWS))
    # At most 64 bands are told by literals; the blocks of those that can hold a result are counted out.
    bands = F.array(*[F.struct(F.lit(s["top"]).alias("top"), F.lit(first[s["band"]]).alias("at"),
                               F.lit(pieces[s["band"]]).alias("n")) for s in sizes])
    reach = F.filter(bands, lambda x: F.col("norm") * x["top"] * (1 + 1e-9) + 1 >= F.col("floor"))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).cast("int")).withColumn(
        "block", F.explode(F.flatten(F.transform(reach, lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))))
    asked = asked.select("block", "part", "vec_id", "vec", "norm", "floor", F.lit(True).alias("asks"))
    # Members go only to the parts of the queries that ask their block.
    parts = asked.groupBy("block").agg(F.collect_set("part").alias("parts"))
    shown = members.join(parts, "block").select(
        "block", F.explode("parts").alias("part"), "vec_id", "vec", "norm",
        F.lit(0).cast("long").alias("floor"), F.lit(False).alias("asks"))
    return asked.unionByName(shown).groupBy("block", "part").applyInPandas(
        _search(k, rotation, max(1, dim // 4)), "query_id long, vec_id long, score long")
