"""Exact top-k on products beyond 53 and 64 bits, against Python integers."""

import random

import pytest
from pyspark.sql import functions as F

from renewlake.llm import topk
from renewlake.llm.topk import LEAST, MOST


def brute(vectors, k):
    rows = []
    for q, mine in vectors:
        if q % 3:
            continue
        scored = sorted((-min(max(sum(x * y for x, y in zip(mine, v)), LEAST), MOST), i) for i, v in vectors if i != q)
        rows += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored[:k], 1)]
    return sorted(rows)


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 27, 1 << 31, 1 << 45, MOST])
def test_products_of_any_size(spark, top):
    rng = random.Random(top)
    vectors = [(i, [rng.choice((-top, top, rng.randint(-top, top), LEAST if top == MOST else -top)) for _ in range(4)])
               for i in range(60)]
    vectors += [(60 + i, list(v)) for i, v in vectors[:12]]  # ties
    df = spark.createDataFrame(vectors, "vec_id long, vec array<long>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_inner_products(df, F.col("vec_id") % 3 == 0).collect())
    assert got == brute(vectors, 5)


def test_few_vectors_with_sums_below_64_bits(spark):
    """Fewer than k others, all of them opposite: still returned, with the least number."""
    vectors = [(0, [1 << 40, 1 << 40]), (1, [-(1 << 40)] * 2), (2, [-(1 << 41)] * 2)]
    df = spark.createDataFrame(vectors, "vec_id long, vec array<long>")
    got = sorted(tuple(r) for r in topk.top_inner_products(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, LEAST), (0, 2, 2, LEAST)]


def test_blocks_asked_in_parts(spark, monkeypatch):
    """Many blocks and parts: members reach every part that asks for them."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    monkeypatch.setattr(topk, "SEEDS", 6)
    rng = random.Random(5)
    vectors = [(i, [rng.randint(-9, 9) * (1 + i % 5) for _ in range(6)]) for i in range(150)]
    df = spark.createDataFrame(vectors, "vec_id long, vec array<long>").repartition(4)
    got = sorted(tuple(r) for r in topk.top_inner_products(df, F.col("vec_id") % 3 == 0).collect())
    assert got == brute(vectors, 5)
