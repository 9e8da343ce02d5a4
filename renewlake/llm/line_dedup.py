"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from renewlake.llm.common import ASCII_SPACE, prepared, stored, texts_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. A text whose bytes are its characters takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that is long enough: its place and the 128-bit hash of its key."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                        F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(ASCII_SPACE)).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars).withColumn("key", ascii_lower(F.col("key")))
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("k1"),
                       F.xxhash64(F.lit("line"), "key").alias("k2"))


class LineRuns:
    """Sorted runs of (key hash, documents, holder), in levels.

    A batch is anti-joined with the runs: keys it brings first get the batch's largest
    document as their holder; keys the runs know only add to the document count. The
    batch's own run goes to level 0. As soon as a level has `fan_in` runs they are merged
    into one run of the next level, so a key is rewritten once per level. Batches must not
    share documents, and come in falling order of document.
    """

    def __init__(self, fan_in: int = 3):
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.fan_in = fan_in
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> DataFrame | None:
        parts = [run for level in self.levels for run in level]
        whole = None
        for part in parts:
            whole = part if whole is None else whole.unionAll(part)
        return whole

    def add(self, lines: DataFrame) -> None:
        own = lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("holder"))
        known = self.runs()
        if known is not None:
            own = stored(own.sortWithinPartitions(*KEY), "line-batch")
            known = known.select(*KEY)
            fresh = own.join(known.hint("merge"), KEY, "left_anti")
            seen = own.join(known.hint("merge"), KEY, "left_semi").withColumn("holder", F.lit(None).cast("long"))
            own = fresh.unionByName(seen)
        self._put(0, stored(own.sortWithinPartitions(*KEY), "line-run"))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, stored(merged.sortWithinPartitions(*KEY), "line-run"))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        whole = runs[0]
        for run in runs[1:]:
            whole = whole.unionAll(run)
        return whole.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder"))

    def totals(self) -> DataFrame | None:
        parts = [run for level in self.levels for run in level]
        return self._merged(parts) if parts else None


def _in_batches(spark: SparkSession, docs: DataFrame, n_batches: int, min_chars: int) -> tuple[DataFrame, int]:
    """The line table with a batch number: equal shares of the documents, the largest ids first."""
    shares = [i / n_batches for i in range(1, n_batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10000).alias("c")).first()["c"] if shares else None
    cuts = sorted(set(cuts or []), reverse=True)
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > cut, F.lit(i)).otherwise(batch)
    lines = line_keys(docs.where(F.col("doc_id").isNotNull()), min_chars).withColumn("batch", batch)
    return stored(lines, "lines"), len(cuts) + 1


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fan_in: int = 3,
                id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Drop repeated lines: (doc_id, text_hash, n_lines, n_dropped, text[, doc]), one row per input row.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of
    at least `min_chars` code points that `min_docs` or more documents hold lose all their
    lines except those in the largest doc_id holding it. The other lines stay, joined by \\n.

    The documents come in `n_batches` batches through levelled runs (`LineRuns`); keys are
    compared by 128 bits of hash.

    Defined cases: a null or empty text is one empty line (kept text ''); a null doc_id holds
    no key and loses no line; rows that repeat a doc_id count as one document; an empty table
    gives an empty table; further columns are ignored, but for those named in `carry`, which
    come back in `doc`.
    """
    spark = prepared(docs.sparkSession)
    docs = texts_of(docs, id_col, text_col, carry)
    lines, n = _in_batches(spark, docs, n_batches, min_chars)
    runs = LineRuns(fan_in)
    for i in range(n):
        runs.add(lines.where(F.col("batch") == i))
    keys = runs.totals().where(F.col("docs") >= min_docs).select(*KEY, "holder")
    drops = (lines.join(keys, KEY).where("doc_id != holder")
             .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")))
    parts = docs.withColumn("text_hash", F.xxhash64("text")).join(drops, ["doc_id", "text_hash"], "left")
    parts = parts.withColumn("lines", split_lines(F.col("text")))
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(kept_at, lambda i: F.get("lines", i)), "\n"))
    return parts.select(
        "doc_id", "text_hash", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"),
        *([] if carry is None else ["doc"]))
