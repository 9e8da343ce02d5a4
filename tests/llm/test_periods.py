"""Periodic runs against a plain search, and op13 against the rule that its contract states."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from renewlake.llm import periods, queries


def plain_runs(words, least_periods=4, least_words=6):
    """(start, length, period) of every run, by comparing words one period apart, for every period."""
    n, smallest = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_words, least_periods * q):
                smallest.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


def plain_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def ascii_words(text):
    return (text or "").encode().split()


def drawn_words(rnd, n, k):
    words = [str(rnd.randrange(k)) for _ in range(n)]
    if n and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("tile", [4, 32, 4096])
def test_runs_over_tile_borders(table, monkeypatch, tile):
    """Tiles of a few words, so that most runs lie over several of them."""
    rnd = random.Random(tile)
    rows = [(i, "\n ".join(drawn_words(rnd, rnd.randint(0, 150), rnd.choice([1, 2, 3, 6])))) for i in range(120)]
    monkeypatch.setattr(periods, "TILE_WORDS", tile)
    parts = []
    for i, text in rows:
        for q, s, e in periods.fragments(periods.word_numbers(text), 4, 6):
            parts += [(i, 0, *x) for x in zip(q.tolist(), s.tolist(), e.tolist())]
    spark = table([]).sparkSession
    frame = spark.createDataFrame(parts + parts[:50], "doc_id long, text_hash long, period long, lo long, hi long")
    got = Counter((r.doc_id, r.start, r.length, r.period) for r in periods.stitch(frame, 4, 6).collect())
    want = Counter((i, *r) for i, text in rows for r in plain_runs(ascii_words(text)))
    assert got == want and len(want) > 60


def test_awkward_rows(table):
    say = lambda seed, n, k=7: " ".join(drawn_words(random.Random(seed), n, k))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "x"), (4, "x " * 5), (5, "x " * 6), (6, "a b " * 4), (7, "a b\x0b" * 3),
            (8, "a a a a a a b b b b b b b"), (9, say(1, 9000, 5000)), (10, "eins zwei " * 6000), (None, "a b " * 9),
            (None, None), (11, "é é " * 8), (12, "A a " * 4), (13, "a b " * 7), (13, "a b " * 7), (13, "c " * 7),
            (14, "a b c a b c a b c a b c x a b c a b c a b c a b c a"), (2**62, "q " * 50)]
    got = periods.collapse_runs(table(rows)).select("doc_id", "n_words", "runs", "text").collect()
    want = []
    for i, text in rows:
        words = ascii_words(text)
        runs = plain_runs(words)
        want.append((i, len(words), tuple(runs), b" ".join(plain_collapse(words, runs)).decode()))
    assert Counter((r[0], r[1], tuple((x.start, x.length, x.period) for x in r[2]), r[3]) for r in got) == Counter(want)
    assert periods.collapse_runs(table([])).collect() == []
    with pytest.raises(ValueError):
        periods.collapse_runs(table([]), least_periods=2)


def test_no_run_is_lost_without_broadcast(table, monkeypatch):
    rows = [(i % 5, "a b " * (i % 7 + 3)) for i in range(40)]
    whole = Counter(map(str, periods.collapse_runs(table(rows)).collect()))
    monkeypatch.setattr(periods, "BROADCAST_RUNS", 0)
    assert Counter(map(str, periods.collapse_runs(table(rows)).collect())) == whole


def test_query(spark, sf):
    """op13 on the whole small table, by its contract in plain Python."""
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d in docs:
        words = ascii_words(d["text"])
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(list(np.unique(words, return_inverse=True)[1])) if n else []
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want.append((d["doc_id"], len(runs), s, length, q, 1000 * length // q if q else None,
                     sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(plain_collapse(words, runs)))))
    got = queries.op13_periodic_runs(spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(want) and sum(w[1] for w in want) > 5
    assert spark.createDataFrame(got).where(F.col("runs_sha256").isNull()).count() == 0
