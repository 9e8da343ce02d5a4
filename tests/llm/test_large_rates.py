"""Sources whose documents are repeated more than 500 times on average."""

import hashlib
import math

import pytest

from renewlake.llm import mixing


def test_rare_source_beside_large_ones(table, spark):
    rows = [(i, "t", "rare") for i in range(40)] + [(100 + i, "t", "big") for i in range(160)] + [(None, "t", None)]
    given = spark.createDataFrame([("rare", 300.0), ("big", 1.0), (None, 9.0)], "source string, weight double")
    docs = table(rows)
    rates = {r.source: r.rate for r in mixing.source_rates(docs, weights=given, epochs=300.0).collect()}
    assert rates["rare"] > 1400 and rates[None] > 1700 and rates["big"] < 2
    got = {}
    for r in mixing.mix_sources(docs, given, epochs=300.0, payload=False).collect():
        got.setdefault((r.doc_id, r.source), []).append(r.copy)
    want = {}
    for i, _, source in rows:
        pieces = max(1, math.ceil(rates[source] / 500))
        rate, total = rates[source] / pieces, 0
        for piece in range(1, pieces + 1):
            seed = f"17:{'null' if i is None else i}" + (f":piece:{piece}" if piece > 1 else "")
            u = (int(hashlib.md5(seed.encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48
            k, p = 0, math.exp(-rate)
            c = p
            while c <= u:
                k += 1
                p *= rate / k
                c += p
            total += k
        if total:
            want[i, source] = list(range(1, total + 1))
    assert {k: sorted(v) for k, v in got.items()} == want
    counts = [len(v) for (_, source), v in got.items() if source == "rare"]
    mean = sum(counts) / 40
    assert mean == pytest.approx(rates["rare"], abs=5 * math.sqrt(rates["rare"] / 40))
    spread = sum((c - mean) ** 2 for c in counts) / 39
    assert 0.3 < spread / rates["rare"] < 2.5
