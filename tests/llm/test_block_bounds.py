"""The bound on shared prefix tokens for blocks whose members differ in size."""

import pytest
from pyspark.sql import functions as F

from renewlake.llm import ngram_join


@pytest.mark.parametrize("percent", [51, 80, 90, 97, 100])
def test_bound_is_the_least_of_all_sizes(spark, percent):
    def up(a, b):
        return -(-a // b)

    def floor_of(n, m):
        return up((n + m) * percent, 100 + percent) - up(max(n, m) * percent, 100) + 1

    rows = []
    for n in (1, 2, 9, 10, 37, 99, 100, 101, 150):
        for least in range(max(1, n // 2), 2 * n + 1, 1 + n // 25):
            for most in {least, least + 1, least + 2, least + 7, least + n // 3, 2 * n + 3}:
                sizes = range(max(least, up(n * percent, 100)), min(most, n * 100 // percent) + 1)
                want = min((floor_of(n, m) for m in sizes), default=None)
                rows.append((n, least, most, want))
    df = spark.createDataFrame(rows, "n int, least int, most int, want int")
    df = df.withColumn("c", F.explode(F.sequence(F.lit(-1), F.coalesce("want", F.lit(1)) + 1)))
    passed = ngram_join._enough(percent, F.col("least"), F.col("most"))
    wrong = df.withColumn("got", passed).where("got != coalesce(c >= want, false)")
    assert wrong.collect() == []


def test_link_to_an_inner_size_of_a_block(table):
    """X links with A alone; the smallest and the largest member of A's block demand one token more."""
    rows = []
    for v in range(12):
        shared = [f"v{v}s{i}" for i in range(99)]
        rarer = [f"v{v}r{i}" for i in range(10)]
        sets = [[*shared, f"v{v}x"], shared + rarer, shared[1:] + rarer, [*shared, *rarer, f"v{v}b"]]
        rows += [(v * 100 + k, " ".join(s)) for k, s in enumerate(sets)]
        # Further documents make the one that the smallest member lacks frequent.
        rows += [(v * 100 + 10 + k, " ".join([shared[0], *(f"v{v}f{k}-{i}" for i in range(20))])) for k in range(5)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table(rows), size=1).collect()}
    assert [got[v * 100 + k] for v in range(12) for k in range(4)] == [v * 100 for v in range(12) for _ in range(4)]
    assert all(got[v * 100 + 10 + k] == v * 100 + 10 + k for v in range(12) for k in range(5))
