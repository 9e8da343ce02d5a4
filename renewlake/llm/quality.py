"""Quality classifier: random-indexing word vectors, pooled, and a small network with a temperature."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from renewlake.llm.common import prepared, texts_of
from renewlake.llm.labelled import labelled_texts


@dataclass(frozen=True)
class Settings:
    max_labelled: int = 20_000  # labelled rows that the network is fitted on
    buckets: int = 1 << 14  # hash buckets of words and of word shapes
    size: int = 24  # length of a word vector
    window: int = 2  # neighbours on either side that make a context
    hidden: int = 32
    epochs: int = 60
    seed: int = 11


@dataclass(frozen=True)
class Model:
    settings: Settings
    contexts: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple
    temperature: float


    def plain(self) -> dict:
        """The model as builtin and numpy values: a broadcast names its classes, and workers may lack the package."""
        return {**vars(self), "settings": vars(self.settings)}


LETTERS, DIGITS, REPEATS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+", re.S)
CACHED_WORDS, CACHED_SHAPES = 100_000, 10_000
BLOCK_CHARS = 200_000  # of the texts that are split into words at once; a longer text goes alone
BLOCK_WORDS = 32_768  # words whose vectors are in memory at once


def _letters(s: str) -> str:
    return "a" if s.islower() else "A" if s.isupper() else "m" if s[1:].islower() else "x"


def word_shape(word: str) -> str:
    """Letters as a, A or Aa, digits as 9, a run of one other sign as that sign.

    Most words are all letters or all digits, perhaps with one sign behind: they need no pattern.
    """
    core, sign = (word[:-1], word[-1]) if len(word) > 1 and not word[-1].isalnum() else (word, "")
    if core.isalpha():
        return _letters(core) + sign
    if core.isdecimal():
        return "9" + sign
    return REPEATS.sub(r"\1", DIGITS.sub("9", LETTERS.sub(lambda found: _letters(found[0]), word)))


def blocks_of(texts: list):
    """(place of the first, texts) of runs of texts that have a bounded number of characters, or are one text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and size + n > BLOCK_CHARS:
            yield first, texts[first:i]
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, texts[first:]


class WordBuckets(dict):
    """Word -> word bucket and shape bucket as one number; a word met for the first time is worked out once."""

    def __init__(self, buckets: int):
        super().__init__()
        self.size, self.shapes = buckets, {}

    def __missing__(self, word: str) -> int:
        shape = _letters(word) if word.isalpha() else word_shape(word)
        place = self.shapes.get(shape)
        if place is None:
            if len(self.shapes) > CACHED_SHAPES:
                self.shapes.clear()
            place = self.shapes[shape] = xxhash.xxh3_64_intdigest(shape.encode(), 1) % self.size
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode()) % self.size * self.size + place
        return value


class Indexer:
    """Random index vectors: a word's own sparse vector plus twice that of its shape."""

    def __init__(self, s: Settings):
        self.s = s
        rng = np.random.default_rng(s.seed)
        signs = rng.integers(0, 2, (2, s.buckets, 4)) * 2.0 - 1
        places = rng.integers(0, s.size, (2, s.buckets, 4))
        self.index = np.zeros((2, s.buckets, s.size), np.float32)
        for kind in (0, 1):
            for j in range(4):
                np.add.at(self.index[kind], (np.arange(s.buckets), places[kind, :, j]), signs[kind, :, j])
        self.doubled = 2 * self.index[1]
        self.cache = WordBuckets(s.buckets)

    def buckets(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word and shape buckets of all words of the texts, and the number of words of each."""
        known = self.cache
        if len(known) > CACHED_WORDS:
            known.clear()
        words, counts = [], []
        for text in texts:
            more = text.split() if text else ()
            words += more
            counts.append(len(more))
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return both // self.s.buckets, both % self.s.buckets, np.array(counts, np.int64)

    def vectors(self, own: np.ndarray, shape: np.ndarray) -> np.ndarray:
        found = self.index[0].take(own, 0)
        found += self.doubled.take(shape, 0)
        return found


def context_vectors(docs: DataFrame, s: Settings) -> np.ndarray:
    """Each word bucket's sum of its neighbours' index vectors over all documents, at length 1."""

    def run(batches):
        indexer = Indexer(s)
        total = np.zeros((s.size, s.buckets))
        for batch in batches:
            for _, texts in blocks_of(batch.column(0).to_pylist()):
                own, shape, counts = indexer.buckets(texts)
                doc = np.repeat(np.arange(len(counts)), counts)
                for at in range(0, len(own), BLOCK_WORDS):
                    end = min(at + BLOCK_WORDS, len(own))
                    # With the neighbours on either side, whose own sums belong to other blocks.
                    near = slice(max(0, at - s.window), min(len(own), end + s.window))
                    vectors, docs_of = indexer.vectors(own[near], shape[near]), doc[near]
                    around = np.zeros_like(vectors)
                    for step in range(1, min(s.window, len(vectors) - 1) + 1):
                        same = (docs_of[step:] == docs_of[:-step])[:, None]
                        around[step:] += vectors[:-step] * same
                        around[:-step] += vectors[step:] * same
                    around = around[at - near.start: end - near.start]
                    for j, column in enumerate(np.ascontiguousarray(around.T, np.float64)):
                        total[j] += np.bincount(own[at:end], column, s.buckets)
        used = np.flatnonzero(total.any(0))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), *[pa.array(column[used]) for column in total]],
                names=["bucket", *[f"x{j}" for j in range(s.size)]])

    columns = [f"x{j}" for j in range(s.size)]
    schema = "bucket int, " + ", ".join(f"{c} double" for c in columns)
    sums = docs.select("text").mapInArrow(run, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns])
    found = sums.toPandas()  # at most one row per bucket
    total = np.zeros((s.buckets, s.size))
    total[found["bucket"].to_numpy()] = found[columns].to_numpy()
    size = np.sqrt((total ** 2).sum(1, keepdims=True))
    # Sums of whole numbers are exact in any order, so the vectors don't depend on the partitions.
    return (total / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(indexer: Indexer, contexts: np.ndarray, texts: list) -> np.ndarray:
    """Mean and spread of the context and index vectors of each text's words, and its length."""
    size = indexer.s.size
    width = 2 * size
    out = np.zeros((len(texts), 2 * width + 1), np.float64)
    known = np.concatenate([contexts, contexts * contexts], 1, dtype=np.float64)
    for first, block in blocks_of(texts):
        own, shape, counts = indexer.buckets(block)
        full = np.flatnonzero(counts)
        doc = np.repeat(np.arange(len(full)), counts[full])
        sums = np.zeros((2, len(full), width))
        for at in range(0, len(own), BLOCK_WORDS):
            part = slice(at, at + BLOCK_WORDS)
            starts = np.flatnonzero(np.diff(doc[part], prepend=-1))
            mine = doc[part][starts]
            found = np.add.reduceat(known.take(own[part], 0), starts, axis=0)
            sums[0][mine, :size] += found[:, :size]
            sums[1][mine, :size] += found[:, size:]
            # Index vectors hold small whole numbers: single precision adds a block of them exactly.
            vectors = indexer.vectors(own[part], shape[part])
            sums[0][mine, size:] += np.add.reduceat(vectors, starts, axis=0)
            vectors *= vectors
            sums[1][mine, size:] += np.add.reduceat(vectors, starts, axis=0)
        n = counts[full][:, None]
        mean, square = sums / n
        out[first + full] = np.concatenate([mean, np.sqrt(np.maximum(square - mean ** 2, 0)), np.log1p(n)], 1)
    return out


def _forward(x: np.ndarray, layers: tuple) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def _fit(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple:
    """Two layers by Adam on the logistic loss, with weight decay."""
    rng = np.random.default_rng(s.seed)
    layers = [rng.standard_normal((x.shape[1], s.hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(s.hidden),
              rng.standard_normal(s.hidden) * np.sqrt(1 / s.hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    t = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at: at + 128]
            w1, b1, w2, b2 = layers
            h = np.maximum(x[rows] @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30)))
            err = (p - y[rows]) / len(rows)
            back = np.outer(err, w2) * (h > 0)
            grads = [x[rows].T @ back + 1e-3 * w1, back.sum(0), h.T @ err + 1e-3 * w2, err.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - 3e-3 * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
    return tuple(layers)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the network has not seen."""
    if not len(y) or y.min() == y.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [np.logaddexp(0, -(2 * y - 1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train_quality(docs: DataFrame, labels: DataFrame, train: Column, settings: Settings = Settings(),
                  label_col: str = "quality") -> Model:
    """Word vectors from all documents; the network from at most `max_labelled` labelled rows."""
    texts = texts_of(docs)
    contexts = context_vectors(texts, settings)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(contexts)
    width = 4 * settings.size + 1

    def run(batches):
        indexer = Indexer(settings)
        for batch in batches:
            if batch.num_rows:
                x = pooled(indexer, sent.value, batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width)
                     .cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = labelled_texts(texts, labels, label_col, train, settings.max_labelled).mapInArrow(
        run, "doc_id long, y int, x array<double>").toPandas()
    sent.unpersist()
    if not len(rows):
        zero = (np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.zeros(1))
        return Model(settings, contexts, np.zeros(width), np.ones(width), zero, 1.0)
    x, y, ids = np.stack(rows["x"]), rows["y"].to_numpy(np.float64), rows["doc_id"].to_numpy()
    order = np.lexsort((*x.T[:2], ids))
    x, y, ids = x[order], y[order], ids[order]
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = np.clip((x - mean) / spread, -8, 8)
    seen = np.array([xxhash.xxh3_64_intdigest(str(i)) % 5 != 0 for i in ids])
    if not seen.any() or seen.all():
        seen = np.ones(len(x), bool)
    layers = _fit(x[seen], y[seen], settings)
    return Model(settings, contexts, mean, spread, layers, _temperature(_forward(x[~seen], layers), y[~seen]))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                  carry: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, score[, doc]): the calibrated probability of label 1 for every whole text.

    A word's vector is the sum of the random index vectors of its neighbours over all
    documents (words by hash bucket; an index vector also stands for the word's shape, so
    that rare words share theirs). A text is the mean and spread of its words' vectors; a
    two-layer network scores it and a temperature, fitted on rows set aside, calibrates it.

    Defined cases: a null or empty text is pooled to zeros and scored; repeated rows score
    alike; null ids stay; an empty table gives an empty table; further columns are ignored,
    but for those named in `carry`, which come back in `doc`. Without labelled rows every
    score is 0.5.
    """
    sent = prepared(docs.sparkSession).sparkContext.broadcast(model.plain())
    rows = texts_of(docs, id_col, text_col, carry)

    def run(batches):
        m = Model(**{**sent.value, "settings": Settings(**sent.value["settings"])})
        indexer = Indexer(m.settings)
        for batch in batches:
            if batch.num_rows:
                x = pooled(indexer, m.contexts, batch.column(1).to_pylist())
                z = _forward(np.clip((x - m.mean) / m.spread, -8, 8), m.layers) / m.temperature
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), *batch.columns[2:]],
                    names=["doc_id", "score", "doc"][: batch.num_columns])

    kept = [f for f in rows.schema.fields if f.name == "doc"]
    return rows.mapInArrow(run, T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), *kept]))
