"""Substring dedup by seed and extend: repeated passages of words go from all but the first document."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from renewlake.llm.common import prepared, stored, texts_of
from renewlake.llm.words import RunHashes, WordHashes, sliding_min

BROADCAST_DOCS = 100_000
SPAN = "array<struct<lo:int,n:int>>"


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _seeds(window: int, gram: int):
    """Winnowed anchors: the least hash of `gram` words in every window; windows in a row with one anchor are one seed."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            parts = []
            for doc, text_hash, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = (text or "").encode().split()
                n = len(words) - window + 1
                if n < 1:
                    continue
                runs = RunHashes(hashes.of(words))
                at = np.arange(len(words) - gram + 1)
                least = sliding_min(runs.of(at, at + gram), window - gram + 1)
                starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                length = np.diff(np.append(starts, n))
                context = runs.of(starts, starts + length + window - 1)
                parts.append((np.full(len(starts), doc), np.full(len(starts), text_hash), least[starts], context,
                              starts, length))
            if parts:
                doc, text_hash, anchor, context, lo, n = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(text_hash, pa.int64()), _signed(anchor), _signed(context),
                     pa.array(lo, pa.int32()), pa.array(n, pa.int32())],
                    names=["doc_id", "text_hash", "anchor", "context", "lo", "n"])

    return run


def _windows(window: int):
    """128-bit hashes of the windows that the given seeds stand for."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for doc, text_hash, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
                words = hashes.of(text.encode().split())
                at = np.unique(np.concatenate([np.arange(s["lo"], s["lo"] + s["n"]) for s in spans]))
                one, two = (RunHashes(words, k).of(at, at + window) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), doc), pa.int64()), pa.array(np.full(len(at), text_hash), pa.int64()),
                     pa.array(at, pa.int32()), _signed(one), _signed(two)],
                    names=["doc_id", "text_hash", "lo", "w1", "w2"])

    return run


def _without(window: int):
    """The text without the words that the spans' windows cover."""

    def run(batches):
        for batch in batches:
            counts, gone, kept = [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    edge[s["lo"]] += 1
                    edge[s["lo"] + s["n"] + window - 1] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                counts.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(compress(words, stays.tolist()) if gone[-1] else words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "text_hash", "n_words", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 12, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, n_removed, text), one row per input row.

    Words are runs of anything but ASCII white space. A word goes if a window of `window`
    consecutive words over it also starts in a document with a smaller doc_id; windows are
    judged on the input. The kept words are joined by one space.

    Seed: every window has an anchor, the least hash of its runs of `gram` words, which
    depends on the window's words alone; neighbouring windows with the same anchor are one
    seed. Documents are joined on anchors, and an anchor that one document has alone is
    dropped. Extend: a seed is extended both ways over all its windows. Seeds of an anchor
    with the same extension (copies, mostly) form a class; all but those in its first
    document are repeats over their whole extension. The first members of an anchor's
    classes are then compared window by window, by 128 bits of hash. So a group of copies
    costs a row per seed, never a pair. Overlapping repeats merge into maximal ones.

    Defined cases: a null or empty text has no words and keeps ''; rows with a null doc_id
    are not compared and lose nothing; rows that repeat a doc_id are one document (they
    don't repeat each other); an empty table gives an empty table; further columns are ignored.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = prepared(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    seeds = stored(rows.where(F.col("doc_id").isNotNull()).mapInArrow(
        _seeds(window, gram), "doc_id long, text_hash long, anchor long, context long, lo int, n int"), "seeds")

    shared = seeds.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z")
    live = stored(seeds.join(shared.select("anchor"), "anchor", "left_semi"), "shared-seeds")
    classes = live.groupBy("anchor", "context", "n").agg(F.min("doc_id").alias("first"))
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(
        F.col("anchor").alias("of_several"))
    judged = live.join(classes, ["anchor", "context", "n"])
    span = F.struct("lo", "n").alias("span")
    repeats = judged.where("doc_id > first").select("doc_id", "text_hash", span)
    firsts = judged.where("doc_id = first").join(several, F.col("anchor") == F.col("of_several"), "left_semi")

    open_docs = stored(firsts.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("spans")), "open-seeds")
    if open_docs.count() <= BROADCAST_DOCS:  # beyond, both sides are shuffled
        ids = F.broadcast(open_docs.select("doc_id", "text_hash"))
        texts = rows.join(ids, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    else:
        texts = rows.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text_hash"])
    windows = stored(texts.join(open_docs, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "spans").mapInArrow(
        _windows(window), "doc_id long, text_hash long, lo int, w1 long, w2 long"), "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"))
    late = windows.join(earliest, ["w1", "w2"]).where("doc_id > first").select(
        "doc_id", "text_hash", F.struct("lo", F.lit(1).alias("n")).alias("span"))

    spans = repeats.unionByName(late).groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))
    spans = spans.select("doc_id", "text_hash", F.col("spans").cast(SPAN).alias("spans"))
    marked = rows.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "text", "spans")
    return marked.mapInArrow(_without(window), "doc_id long, text_hash long, n_words long, n_removed long, text string")
