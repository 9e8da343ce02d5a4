"""Collocations against a plain count in Python, and the summaries' promise."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from renewlake.llm import phrases

COLUMNS = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "text", "phrase", "n", "gram", "size", "k", "a")])


def plain(rows, threshold=10, most=3, percent=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for p, a in f.items():
        lang, words = p[0], p[1:]
        if a < threshold or len(words) < 2:
            continue
        if any(len(q) > len(p) and q[0] == lang and 100 * c >= percent * a and c >= threshold
               and any(q[i:i + len(words)] == words for i in range(1, len(q))) for q, c in f.items()):
            continue
        score, cut = min((1_000_000 * a * a // (f[(lang, *words[:i])] * f[(lang, *words[i:])]), i) for i in range(1, len(words)))
        phrase = " ".join(words)
        out.setdefault(lang, []).append(
            (-score, -a, phrase.encode(), phrase, a, f[(lang, *words[:cut])], f[(lang, *words[cut:])], n[lang], score))
    return sorted((lang, i + 1, *x[3:]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top]))


def awkward():
    rnd = random.Random(4)
    say = lambda k, v=25: " ".join(rnd.choice("abcdeABü") + str(rnd.randrange(v) ** 2 // v) for _ in range(k))
    breaks = [". ", ",", " ; ", ":", "!", "?", "\n", "\x0b", "\x0c", "\r\n", "\t", "  "]
    rows = [(None, None), ("en", ""), ("en", " \t\n.."), ("de", "x"), (None, "New York " * 12), ("", "New York " * 12),
            ("en", "yes no " * 4000), ("en", "word"), ("xx", "an b c " * 11), ("en", "NEW york city. " * 15), ("en", say(6000))]
    for _ in range(80):
        rows.append((rnd.choice(["en", "de", None]), "".join(say(rnd.randrange(9), 6) + rnd.choice(breaks) for _ in range(15))))
    return rows + rows[20:40]


@pytest.fixture
def small(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y", None, "1", "2", "3") for r in rows], COLUMNS)


def result(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_against_plain_count(small):
    rows = awkward()
    want = plain(rows)
    assert result(phrases.collocations(small(rows))) == want and len(want) > 40
    assert {w[0] for w in want} >= {"en", "de", "und", ""}
    assert result(phrases.collocations(small(rows), top=3)) == plain(rows, top=3)
    assert result(phrases.collocations(small(rows), most=4, threshold=7)) == plain(rows, threshold=7, most=4)


def test_full_summaries_and_shuffled_survivors(small, monkeypatch):
    """Summaries so small that they take off counts, chunks of few words, and no broadcast at all."""
    rows = awkward()
    want = plain(rows)
    monkeypatch.setattr(phrases, "PART_MASS", 2000)
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 300)
    assert result(phrases.collocations(small(rows))) == want
    monkeypatch.setattr(phrases, "BROADCAST_SURVIVORS", -1)
    monkeypatch.setattr(phrases, "BROADCAST_COUNTS", -1)
    assert result(phrases.collocations(small(rows))) == want


def test_empty(small):
    assert phrases.collocations(small([])).collect() == []
    assert phrases.collocations(small([("en", "too few words"), (None, None)])).collect() == []
    with pytest.raises(ValueError):
        phrases.frequent_ngrams(small([]), threshold=0)


@pytest.mark.parametrize("threshold", [2, 10, 40])
def test_summary_loses_no_frequent_key(threshold):
    rnd = np.random.default_rng(threshold)
    for _ in range(30):
        stream = (rnd.zipf(1.3, 5000) % 900).astype(np.uint64)
        summary = phrases.Summary(len(stream) // threshold + 1, threshold)
        for part in np.array_split(stream, 40):
            summary.add(*np.unique(part, return_counts=True))
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= threshold]) <= set(summary.survivors()) and summary.taken < threshold
        assert len(summary.keys) <= summary.capacity


def test_summary_grows_rather_than_lose():
    """More mass than the capacity was planned for."""
    stream = np.repeat(np.arange(3000, dtype=np.uint64), 12)
    np.random.default_rng(1).shuffle(stream)
    summary = phrases.Summary(100, 10)
    for part in np.array_split(stream, 60):
        summary.add(*np.unique(part, return_counts=True))
    assert len(summary.survivors()) == 3000


def test_hash_ties_are_told_apart(small, monkeypatch):
    """Every word has the same hash: only the words themselves can tell phrases apart."""
    monkeypatch.setattr(phrases.xxhash, "xxh3_64_intdigest", lambda *_: 7)
    chunk = phrases.Chunk()
    chunk.add("en", "a b. a c " * 3)
    chunk.close()
    rows = {}
    monkeypatch.setattr(phrases, "chunks", lambda _: [chunk])
    for batch in phrases._counted(2, 1, None)(iter(())):
        for r in batch.to_pylist():
            rows[r["phrase"]] = rows.get(r["phrase"], 0) + r["n"]
    assert rows == {None: 12, "a": 6, "b": 3, "c": 3, "a b": 3, "a c": 3, "c a": 2}
