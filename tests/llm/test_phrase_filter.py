"""Survivors too many to broadcast as hashes: a filter keeps the other n-grams out of the shuffle."""

import numpy as np
import pyarrow as pa
import pytest

from renewlake.llm import phrases


def test_filter_holds_every_survivor_and_few_others():
    rnd = np.random.default_rng(3)
    parts = 7
    value = np.unique(phrases.partitioned(rnd.integers(0, 1 << 63, 40_000).astype(np.uint64), parts))
    rnd.shuffle(value)
    wanted, others = value[:20_000], np.sort(value[20_000:])
    width = phrases.Filter.width_for(parts, len(wanted))
    made = phrases.Filter(width, np.zeros(parts * width // 8, np.uint8))
    batches = [pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64))], names=["gram"]) for w in np.array_split(wanted, 9)]
    step = made.width // 8
    for batch in made.segments(batches):
        for part, bits in zip(*[c.to_pylist() for c in batch.columns]):
            made.bits[part * step:(part + 1) * step] |= np.frombuffer(bits, np.uint8)
    assert made.holds(np.sort(wanted)).all()
    assert made.holds(others).mean() < 0.02
    assert len(made.bits) <= len(wanted) * phrases.FILTER_BITS / 8 + parts
    assert made.holds(np.zeros(0, np.uint64)).tolist() == []


def test_filter_size_is_bounded(monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BYTES", 1000)
    assert phrases.Filter.width_for(10, 10_000_000) * 10 <= 8 * (1000 + 10)


@pytest.mark.parametrize("size", [phrases.FILTER_BYTES if hasattr(phrases, "FILTER_BYTES") else 0, 40])
def test_second_pass_leaves_out_rare_ngrams(spark, monkeypatch, size):
    """Beyond the broadcast of hashes only n-grams that pass the filter become rows; a full filter costs rows, not results."""
    rnd = np.random.default_rng(5)
    rows = [("en", " ".join(f"w{x}" for x in rnd.integers(0, 4000, 60)) + ". New York is big") for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "FILTER_BYTES", size, raising=False)
    want = sorted(map(tuple, phrases.frequent_ngrams(docs).collect()))
    seen, counted = [], phrases._counted

    def watched(*given):
        run = counted(*given)
        batches = [pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})]
        seen.append(sum(b.num_rows for b in run(iter(batches))))
        return run

    monkeypatch.setattr(phrases, "_counted", watched)
    monkeypatch.setattr(phrases, "BROADCAST_SURVIVORS", -1)
    assert sorted(map(tuple, phrases.frequent_ngrams(docs).collect())) == want and len(want) > 10
    every = sum(b.num_rows for b in counted(3, 1, None)(iter(
        [pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})])))
    assert len(seen) == 1 and seen[0] < (every if size == 40 else every / 10)
