"""Periodic runs of words, found on overlapping tiles per octave of periods and stitched over tile borders."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from renewlake.llm.common import prepared, stored, texts_of
from renewlake.llm.words import mixed

TILE_WORDS = 4096  # least step from tile to tile
BROADCAST_RUNS = 500_000
RUNS = "array<struct<start:long,length:long,period:long>>"


class Numbers(dict):
    """Words by the order in which they first came."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def word_numbers(text: str | None) -> np.ndarray:
    """One number for each word of a text, the same for the same word."""
    words = (text or "").encode().split()
    return np.fromiter(map(Numbers().__getitem__, words), np.int64, len(words))


def window_hashes(numbers: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of all windows of 1, 2, 4, ... words, up to `longest`."""
    levels = [mixed(numbers.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))]
    while 2 << (len(levels) - 1) <= min(longest, len(numbers)):
        half, below = 1 << (len(levels) - 1), levels[-1]
        levels.append(mixed(below[:-half] * np.uint64(0xD6E8FEB86659FD93) + below[half:]))
    return levels


def _reach(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """The Z-function of tile boundaries: how many words from a and from b on are the same.

    With step 1 it looks ahead, with -1 back; `room` is how far each pair may go.
    """
    z = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        fits = z + size <= room
        shift = z if step > 0 else -z - size
        at = np.where(fits, a + shift, 0), np.where(fits, b + shift, 0)
        z += np.where(fits & (levels[k][at[0]] == levels[k][at[1]]), size, 0)
    return z


def solve_tile(levels: list[np.ndarray], lo: int, hi: int, octave: int, periods: np.ndarray) -> tuple:
    """(period, start, end) of the periodic stretches inside the words lo to hi, cut off at the tile's borders.

    Boundaries lie 2^octave words apart. A stretch of at least three periods has a boundary
    whose next 2^octave words are met again one period on; the Z-functions there, ahead and
    back, give its two ends. Of periods with the same ends the smallest stays: two periods of
    one stretch that holds both imply their common divisor, so the others say nothing new.
    """
    size = 1 << octave
    window = levels[octave]
    at = np.arange(lo, hi - 2 * size + 1, size)
    there = at[:, None] + periods[None, :]
    same = there + size <= hi
    same &= window[at][:, None] == window[np.minimum(there, len(window) - 1)]
    which, p = np.nonzero(same)
    if not len(which):
        none = np.zeros(0, np.int64)
        return none, none, none
    a, q = at[which], periods[p]
    start = a - _reach(levels, a, a + q, a - lo, -1)
    end = a + q + _reach(levels, a, a + q, hi - a - q, 1)
    order = np.lexsort((q, end, start))
    q, start, end = q[order], start[order], end[order]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    return q[first], start[first], end[first]


def tiles(n: int, octave: int):
    """Borders of the tiles of a text of n words: six times 2^octave words overlap, three periods at least."""
    size = 1 << octave
    step, overlap = max(TILE_WORDS, 16 * size), 6 * size
    lo = 0
    while True:
        hi = min(n, lo + step + overlap)
        yield lo, hi
        if hi == n:
            return
        lo += step


def fragments(numbers: np.ndarray, least_periods: int, least_words: int) -> list[tuple]:
    """(period, start, end) arrays of all tiles of a text; stretches that end inside their tile are whole runs."""
    n = len(numbers)
    longest = n // least_periods
    if n < least_words or not longest:
        return []
    levels = window_hashes(numbers, n)
    found = []
    for octave in range(longest.bit_length()):
        periods = np.arange(1 << octave, min(2 << octave, longest + 1))
        for lo, hi in tiles(n, octave):
            q, start, end = solve_tile(levels, lo, hi, octave, periods)
            cut = ((start == lo) & (lo > 0)) | ((end == hi) & (hi < n))
            least = np.where(cut, 2 * q, np.maximum(least_periods * q, least_words))
            keep = end - start >= least
            for p, s, e in zip(q[keep].tolist(), start[keep].tolist(), end[keep].tolist()):
                if not np.array_equal(numbers[s:e - p], numbers[s + p:e]):  # 64-bit hashes of windows agreed
                    raise ValueError("two windows of words share a hash")
            if keep.any():
                found.append((q[keep], start[keep], end[keep]))
    return found


def _fragments(least_periods: int, least_words: int):
    def run(batches):
        for batch in batches:
            for doc, text_hash, text in zip(*[c.to_pylist() for c in batch.columns]):
                found = fragments(word_numbers(text), least_periods, least_words)
                if found:
                    q, start, end = map(np.concatenate, zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(q), pa.int64()), pa.array(np.full(len(q), text_hash), pa.int64()),
                         pa.array(q), pa.array(start), pa.array(end)],
                        names=["doc_id", "text_hash", "period", "lo", "hi"])

    return run


def _collapse(batches):
    """The words of a text without the repeats inside its runs."""
    for batch in batches:
        counts, kept = [], []
        for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = (text or "").encode().split()
            counts.append(len(words))
            if runs:
                edge = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                words = compress(words, (np.cumsum(edge[:-1]) == 0).tolist())
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), batch.column(3), pa.array(kept, pa.string())],
            names=["doc_id", "text_hash", "n_words", "runs", "text"])


def stitch(parts: DataFrame, least_periods: int, least_words: int) -> DataFrame:
    """(doc_id, text_hash, start, length, period): fragments of neighbouring tiles joined to whole runs.

    Fragments of a document and period belong together where they overlap by a period or
    more; less than that, they are two stretches.
    """
    of_period = Window.partitionBy("doc_id", "text_hash", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(of_period.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.distinct().withColumn("opens", F.coalesce(F.col("lo") > reach - F.col("period"), F.lit(True)).cast("int"))
    stretch = opened.withColumn("stretch", F.sum("opens").over(of_period.rowsBetween(Window.unboundedPreceding, 0)))
    whole = stretch.groupBy("doc_id", "text_hash", "period", "stretch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    long_enough = F.col("hi") - F.col("lo") >= F.greatest(F.col("period") * least_periods, F.lit(least_words))
    runs = whole.where(long_enough).groupBy("doc_id", "text_hash", "lo", "hi").agg(F.min("period").alias("period"))
    return runs.select("doc_id", "text_hash", F.col("lo").alias("start"), (F.col("hi") - F.col("lo")).alias("length"), "period")


def collapse_runs(docs: DataFrame, least_periods: int = 4, least_words: int = 6, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, runs, text), one row per input row.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch of
    words with smallest period q (words q apart are the same) that has at least
    `least_periods` periods (three or more) and `least_words` words and that no neighbouring
    word extends. `runs` holds start, length and period of each, by start and period; `text`
    the words, joined by one space, without those that a run holds after its first period.

    Every document is exploded into overlapping tiles for each octave of periods, with tiles
    as long as the octave needs; tiles are solved alone, and only the stretches found go over
    the network: by document and period, where pieces of neighbouring tiles are stitched. A
    document of n words costs n log n steps, whatever repeats in it, and 8 n log n bytes.

    Defined cases: a null or empty text has no words and no runs and keeps ''; rows with a
    null doc_id are searched like others; rows that repeat a doc_id with the same text give
    the same result, with another text their own; an empty table gives an empty table;
    further columns are ignored.
    """
    if least_periods < 3 or least_words < 1:
        raise ValueError("a run needs at least three periods and one word")
    prepared(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    parts = rows.mapInArrow(_fragments(least_periods, least_words),
                            "doc_id long, text_hash long, period long, lo long, hi long")
    runs = stored(stitch(parts, least_periods, least_words).groupBy(
        F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).agg(
        F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found")).select(
        "of_doc", "of_text", F.transform("found", lambda r: F.struct(
            r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs")), "runs")
    total = runs.agg(F.coalesce(F.sum(F.size("runs") + 1), F.lit(0))).first()[0]
    side = F.broadcast(runs) if total <= BROADCAST_RUNS else runs  # beyond, both sides are shuffled
    joined = rows.join(side, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left")
    marked = joined.select("doc_id", "text_hash", "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    return marked.mapInArrow(_collapse, f"doc_id long, text_hash long, n_words long, runs {RUNS}, text string")
