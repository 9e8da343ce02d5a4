"""Phrase collocations: Misra-Gries summaries name the n-grams that may be frequent, a second pass counts them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from renewlake.llm.common import prepared, stored
from renewlake.llm.words import mixed

CHUNK_WORDS = 300_000  # words that a task counts at once; a longer document is a chunk of its own
PART_MASS = 1 << 23  # n-grams, at most, that one hash partition is planned for
KEY_BITS = 32  # of an n-gram's hash, beside its partition
BROADCAST_SURVIVORS = 4_000_000  # hashes of 8 bytes; more of them are broadcast as a filter
FILTER_BITS = 12  # for each survivor, as long as the filter stays within FILTER_BYTES
FILTER_BYTES = 1 << 26
FILTER_PROBES = 4
BROADCAST_COUNTS = 300_000  # counted phrases
NO_LANG = "und"

PROBE = np.uint64(0xC2B2AE3D27D4EB4F)
LOWER = bytes(c + 32 if 65 <= c <= 90 else 46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def piece_words(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z alone); the word b'.' stands between pieces."""
    return (text or "").encode().translate(LOWER).replace(b".", b" . ").split()


class Numbers(dict):
    """Words by the order in which they first came; b'.' is 0."""

    def __init__(self):
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Chunk:
    """The words of some documents as numbers, with a 64-bit hash for each n-gram of one language."""

    def __init__(self):
        self.index, self.langs, self.parts, self.size = Numbers(), [], [], 0

    def add(self, lang: str | None, text: str | None) -> None:
        words = piece_words(text)
        words.append(b".")
        self.langs.append(NO_LANG if lang is None else lang)
        self.parts.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def close(self) -> None:
        self.ids, self.words = np.concatenate(self.parts), list(self.index)
        self.names = sorted(set(self.langs))
        order = {name: i for i, name in enumerate(self.names)}
        self.lang = np.repeat(np.array([order[x] for x in self.langs], np.int32), [len(p) for p in self.parts])
        self.of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.of_lang = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.names], np.uint64)
        self.parts = self.index = None

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every run of n words inside a piece."""
        count = max(len(self.ids) - n + 1, 0)
        inside = np.ones(count, bool)
        for i in range(n):
            inside &= self.ids[i:count + i] != 0
        at = np.flatnonzero(inside)
        value = self.of_lang[self.lang[at]] + np.uint64(n)
        for i in range(n):
            value = mixed(value * PROBE + self.of_word[self.ids[at + i]])
        return at, value


def chunks(batches):
    """Chunks of about CHUNK_WORDS words from batches of (lang, text)."""
    now = Chunk()
    for batch in batches:
        for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
            now.add(lang, text)
            if now.size >= CHUNK_WORDS:
                now.close()
                yield now
                now = Chunk()
    if now.size:
        now.close()
        yield now


def partitioned(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition in the high bits, KEY_BITS of the hash below it: n-grams that share a value only raise each other's count."""
    part = (hashes >> np.uint64(KEY_BITS)) % np.uint64(parts)
    return (part << np.uint64(KEY_BITS)) | (hashes & np.uint64((1 << KEY_BITS) - 1))


def _summaries(most: int, parts: int):
    """Exact counts of each chunk, a row of packed keys (four bytes) and counts for each hash partition."""

    def run(batches):
        for chunk in chunks(batches):
            found = np.concatenate([partitioned(chunk.grams(n)[1], parts) for n in range(1, most + 1)])
            keys, counts = np.unique(found, return_counts=True)
            part = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            packed = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8]
            counts = counts.astype("<i4")
            ends = np.append(first[1:], len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[first], pa.int32()),
                 pa.array([packed[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                 pa.array([counts[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())],
                names=["part", "keys", "counts"])

    return run


class Summary:
    """A Misra-Gries summary that merges others: no key with `threshold` or more occurrences is ever lost.

    Taking d off every counter when more than `capacity` are left costs each key at most d,
    and at least d times capacity occurrences; with a capacity above mass / threshold all
    that is taken off stays below the threshold. Should a partition hold more mass than it
    was planned for, the summary grows instead of taking off more.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = capacity, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.size = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            if self.taken + off < self.threshold:
                self.taken += off
                left = counts > off
                keys, counts = keys[left], counts[left] - off
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        """Keys that may occur `threshold` times: the counter and all that was taken off reach it."""
        self.merge()
        return self.keys[self.counts + self.taken >= self.threshold]


def _merge(capacity: int, threshold: int):
    """Summaries of the partitions of this task, which come in order, one after the other."""

    def out(part, summary):
        kept = summary.survivors() | (np.uint64(part) << np.uint64(KEY_BITS))
        return pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int64))], names=["gram"])

    def run(batches):
        now = summary = None
        for batch in batches:
            for part, packed, counts in zip(*[c.to_pylist() for c in batch.columns]):
                if part != now:
                    if summary:
                        yield out(now, summary)
                    now, summary = part, Summary(capacity, threshold)
                keys = np.zeros((len(counts) // 4, 8), np.uint8)
                keys[:, :KEY_BITS // 8] = np.frombuffer(packed, np.uint8).reshape(-1, KEY_BITS // 8)
                summary.add(keys.view("<u8").ravel().astype(np.uint64), np.frombuffer(counts, "<i4").astype(np.int64))
        if summary:
            yield out(now, summary)

    return run


def _holds(wanted: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values are among the wanted ones, both sorted."""
    spot = np.searchsorted(wanted, value)
    hit = spot < len(wanted)
    hit[hit] = wanted[spot[hit]] == value[hit]
    return hit


class Filter:
    """Survivors as bits: each hash partition has a segment of its own, in which a value sets FILTER_PROBES bits.

    Every survivor passes, and of the other n-grams the same ones each time. So what passes
    is counted whole, and the threshold drops what did not survive.
    """

    def __init__(self, width: int, bits: np.ndarray | None = None):
        self.width, self.bits = width, bits

    @staticmethod
    def width_for(parts: int, survivors: int) -> int:
        """Bits of a segment, in whole bytes."""
        return max(8, -(-min(FILTER_BITS * survivors, 8 * FILTER_BYTES) // parts // 8) * 8)

    def spots(self, value: np.ndarray, probe: int) -> np.ndarray:
        """The bit of one probe inside the value's segment."""
        spread = mixed(value * PROBE)
        low, high = spread & np.uint64(0xFFFFFFFF), (spread >> np.uint64(32)) | np.uint64(1)
        return ((low + np.uint64(probe) * high & np.uint64(0xFFFFFFFF)) * np.uint64(self.width)) >> np.uint64(32)

    def segments(self, batches):
        """The segment of each partition with the bits that its survivors set; they come partition by partition."""
        now, segment = None, None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([np.packbits(segment).tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            value = batch.column(0).to_numpy().astype(np.uint64)
            part = (value >> np.uint64(KEY_BITS)).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(first, np.append(first[1:], len(part))):
                if part[a] != now:
                    if now is not None:
                        yield out()
                    now, segment = int(part[a]), np.zeros(self.width, bool)
                for probe in range(FILTER_PROBES):
                    segment[self.spots(value[a:b], probe)] = True
        if now is not None:
            yield out()

    def holds(self, value: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(value), bool)
        left = np.arange(len(value))
        for probe in range(FILTER_PROBES):
            some = value[left]
            spot = (some >> np.uint64(KEY_BITS)) * np.uint64(self.width) + self.spots(some, probe)
            left = left[(self.bits[spot >> np.uint64(3)] << (spot & np.uint64(7)).astype(np.uint8)) & np.uint8(128) != 0]
        hit[left] = True
        return hit


def filter_bits(survivors: DataFrame, parts: int, width: int) -> np.ndarray:
    """The filter with the bits of all survivors; the driver sees no hash, only segments."""
    step = width // 8
    bits = np.zeros(parts * step, np.uint8)
    for batch in survivors.mapInArrow(Filter(width).segments, "part long, bits binary").toArrow().to_batches():
        for part, some in zip(*batch.columns):
            bits[part.as_py() * step:(part.as_py() + 1) * step] |= np.frombuffer(some.as_py(), np.uint8)
    return bits


def _rows(gram, lang, size, phrase, n):
    return pa.RecordBatch.from_arrays(
        [pa.array(gram, pa.int64()), pa.array(lang, pa.string()), pa.array([size] * len(n), pa.int32()),
         pa.array(phrase, pa.string()), pa.array(n, pa.int64())], names=["gram", "lang", "size", "phrase", "n"])


def _counted(most: int, parts: int, survivors, width: int = 0):
    """Counts of n-grams as text, of the broadcast survivors or of all; size 0 counts all words of a language.

    With a width, the survivors are the bits of a filter.
    """

    def run(batches):
        wanted = None if survivors is None else survivors.value
        passing = Filter(width, wanted).holds if width else lambda value: _holds(wanted, value)
        for chunk in chunks(batches):
            total = np.bincount(chunk.lang[chunk.ids != 0], minlength=len(chunk.names)).tolist()
            yield _rows([None] * len(total), chunk.names, 0, [None] * len(total), total)
            for n in range(1, most + 1):
                at, value = chunk.grams(n)
                value = partitioned(value, parts)
                order = np.argsort(value, kind="stable")
                at, value = at[order], value[order]
                if wanted is not None:
                    hit = passing(value)
                    at, value = at[hit], value[hit]
                if not len(at):
                    continue
                # n-grams of one hash are told apart by their words
                codes = np.stack([value.astype(np.int64), chunk.lang[at], *[chunk.ids[at + i] for i in range(n)]])
                first = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(axis=0)]))
                counts = np.diff(np.append(first, len(at)))
                codes = codes[:, first]
                for lo in range(0, len(first), 20_000):
                    some = codes[:, lo:lo + 20_000]
                    text = [b" ".join([chunk.words[i] for i in ids]).decode() for ids in some[2:].T.tolist()]
                    yield _rows(some[0], [chunk.names[i] for i in some[1].tolist()], n, text, counts[lo:lo + 20_000])

    return run


def frequent_ngrams(docs: DataFrame, most: int = 3, threshold: int = 10, text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, n): every phrase of up to `most` words with `threshold` or more occurrences in its language.

    One more row for each language, with size 0 and no phrase, counts all its words. First
    pass: n-grams fall into hash partitions, as many as keep each at PART_MASS n-grams, and
    each partition is one Misra-Gries summary with room for more than mass / threshold
    counters, so that every frequent n-gram survives. Second pass: the texts are read again
    and the survivors counted exactly, as text. Survivors are broadcast while they are few,
    beyond that a filter that all of them pass; the few others that pass are counted too, and
    fall short of the threshold.
    """
    if most < 1 or threshold < 1:
        raise ValueError("phrases have at least one word and one occurrence")
    spark = prepared(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    mass = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-mass * most // 2 // PART_MASS))  # a word takes two bytes at least
    capacity = PART_MASS // threshold + 1
    packed = rows.mapInArrow(_summaries(most, parts), "part int, keys binary, counts binary")
    dealt = packed.repartition(parts, "part").sortWithinPartitions("part")
    survivors = stored(dealt.mapInArrow(_merge(capacity, threshold), "gram long"), "survivors")

    schema = "gram long, lang string, size int, phrase string, n long"
    found, width = survivors.count(), 0
    if found <= BROADCAST_SURVIVORS:
        wanted = np.sort(survivors.toArrow().column("gram").to_numpy().astype(np.uint64))
    else:
        width = Filter.width_for(parts, found)
        wanted = filter_bits(survivors, parts, width)
    sent = spark.sparkContext.broadcast(wanted)
    counted = rows.mapInArrow(_counted(most, parts, sent, width), schema)
    summed = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    result = stored(summed.where((F.col("size") == 0) | (F.col("n") >= threshold)), "ngrams")
    sent.unpersist()
    return result


def _sub(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = 2, most: int = 3, threshold: int = 10, absorbed_percent: int = 50,
                 top: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases whose words occur together more often than apart.

    Texts are lower-cased (A-Z), cut into pieces at `. , ; : ! ?` and line ends and into
    words at spaces and tabs; a phrase lies inside a piece. a counts a phrase, n all words of
    its language. Cutting it into two parts, met l and r times, gives
    floor(1000000 a^2 / (l r)); the least of its cuts counts, ties to the shortest first
    part. A phrase goes if a longer one that holds it is met at least `absorbed_percent` as
    often. Ranks: score, then a, both falling, then the phrase in byte order. Arithmetic is
    exact, in decimals of 38 digits.

    Defined cases: null and empty texts have no words; a null language is `und`; rows that
    repeat a doc_id count each; an empty table, or one without frequent phrases, gives an
    empty table; further columns are ignored.
    """
    grams = frequent_ngrams(docs, most, threshold, text_col, lang_col)
    phrases = grams.where("size > 0")
    side = F.broadcast if phrases.count() <= BROADCAST_COUNTS else (lambda df: df)  # beyond, the planner chooses
    words = F.split("phrase", " ")
    candidates = phrases.where(F.col("size") >= least).select("lang", "size", "phrase", F.col("n").alias("a"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "*", _sub(words, F.lit(1), F.col("k")).alias("first"), _sub(words, F.col("k") + 1, F.col("size")).alias("rest"))
    left = side(phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")))
    right = side(phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")))
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    parted = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).select(
        "lang", "size", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * a * a).alias("above"),
        (l * r).alias("below"))
    scored = parted.withColumn("score", F.expr("above div below")).groupBy("lang", "size", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where(F.col("size") > least).select("lang", "size", words.alias("w"), "a")
    shorter = longer.withColumn("part", F.explode(F.sequence(F.lit(least), F.col("size") - 1)))
    inside = shorter.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)))
    holders = inside.groupBy("lang", _sub(F.col("w"), F.col("from"), F.col("part")).alias("phrase")).agg(
        F.max("a").alias("longer"))
    share = F.lit(absorbed_percent).cast("decimal(19,0)") * a
    stays = F.col("longer").isNull() | (F.lit(100).cast("decimal(19,0)") * F.col("longer").cast("decimal(19,0)") < share)
    kept = scored.join(side(holders), ["lang", "phrase"], "left").where(stays)

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = grams.where("size = 0").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        "n", F.col("cut.score").alias("score"))
