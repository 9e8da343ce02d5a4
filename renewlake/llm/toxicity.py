"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from renewlake.llm.common import prepared, stored, texts_of
from renewlake.llm.labelled import labelled_texts
from renewlake.llm.words import RunHashes, WordHashes

PREFIXES = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 100_000


@dataclass(frozen=True)
class Settings:
    max_labelled: int = 60_000  # labelled rows that the model is fitted on
    max_features: int = 20_000  # words and word beginnings that the model keeps
    prior_share: float = 0.002  # weight of the Dirichlet prior, as a share of the labelled documents
    least_prior: float = 10.0  # and at least so many documents
    doubt: float = 1.5  # standard errors taken off a feature's log-odds to get its lower bound
    least_odds: float = 2.0  # lower bound that a feature must reach
    least_docs: int = 3  # toxic documents a feature must occur in
    drift: float = -0.3  # score of a token without a feature
    significant: float = 0.01  # p-value of a passage


@dataclass(frozen=True)
class Model:
    scores: dict  # feature -> (lower bound, log-odds); a word is written "word", a beginning "begin*"
    drift: float
    scale: float  # Karlin-Altschul lambda of the scores
    log_k: float  # and the logarithm of its K
    significant: float
    slope: float = 1.0
    offset: float = -2.0


def _features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]]


def token_scores(model: Model, cache: dict, text: str) -> tuple[list, list, int]:
    """Places and scores of the tokens that have a feature, and the number of tokens."""
    at, scores, n = [], [], 0
    for n, found in enumerate(LETTERS.finditer(text), 1):
        word = found[0].lower()
        score = cache.get(word)
        if score is None:
            if len(cache) > CACHED_WORDS:
                cache.clear()
            known = [model.scores[f] for f in _features(word) if f in model.scores]
            score = cache[word] = max(known)[1] if known else 0.0
        if score:
            at.append((n - 1, found.start(), found.end()))
            scores.append(score)
    return at, scores, n


def maximal_segments(at: list, scores: list, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, in linear time: (first, last, score) over the scored tokens.

    Tokens between scored ones each add the drift. Kept segments form a stack; each knows
    the nearest one before it that starts from a lower sum, so that no search repeats.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, lower one
    total, place = 0.0, -1
    for i, (where, score) in enumerate(zip(at, scores)):
        total += drift * (where[0] - place - 1)
        place = where[0]
        before, total = total, total + score
        if score <= 0:
            continue
        first, low = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, i, low, total, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


def log_p(model: Model, score: float, n: int) -> float:
    """log10 of the p-value of a segment score among n tokens, by the extreme-value law."""
    expected = model.log_k + np.log(max(n, 1)) - model.scale * score
    return float(np.log10(-np.expm1(-np.exp(expected)))) if expected > -30 else float(expected / np.log(10))


def evidence(model: Model, at: list, scores: list, n: int) -> tuple[float, list]:
    """Evidence of a text (minus log10 p of its best passage, a little more for each further one) and its passages."""
    found = [(a, b, s, log_p(model, s, n)) for a, b, s in maximal_segments(at, scores, model.drift)]
    found = [x for x in found if x[3] <= np.log10(model.significant)]
    if not found:
        return 0.0, []
    return min(20.0, -min(x[3] for x in found)) + np.log(len(found)), found


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """Of labelled texts with the same least hash of eight words one stays, twice over: copies would count as proof."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            marks = ([], [])
            for text in batch.column(1).to_pylist():
                words = hashes.of((text or "").encode().lower().split())
                at = np.arange(max(1, len(words) - 7))
                ends = np.minimum(at + 8, len(words))
                for which, mark in enumerate(marks):
                    mark.append(int(RunHashes(words, which).of(at, ends).min().view(np.int64)) if len(words) else 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(m, pa.int64()) for m in marks]], names=["doc_id", "text", "y", "m1", "m2"])

    marked = rows.mapInArrow(run, "doc_id long, text string, y int, m1 long, m2 long")
    for mark in ("m1", "m2"):
        least = marked.groupBy(mark).agg(F.min("doc_id").alias("least"))
        marked = marked.join(least, mark).where("doc_id = least").drop("least")
    return marked.select("doc_id", "text", "y")


def _word_counts(train: DataFrame) -> DataFrame:
    """(word, fold, toxic, clean): documents with the word, by label."""

    def run(batches):
        for batch in batches:
            sums = Counter()
            for text, y, fold in zip(*[c.to_pylist() for c in batch.columns]):
                sums.update((w, fold, y) for w in {w.lower() for w in LETTERS.findall(text or "")})
            if sums:
                words, folds, ys = zip(*sums)
                n, toxic = np.array(list(sums.values())), np.array(ys) == 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words), pa.array(folds, pa.int32()), pa.array(n * toxic), pa.array(n * ~toxic)],
                    names=["word", "fold", "toxic", "clean"])

    return train.select("text", "y", "fold").mapInArrow(
        run, "word string, fold int, toxic long, clean long").groupBy("word", "fold").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _model(counts: DataFrame, n_toxic: int, n_clean: int, s: Settings) -> Model:
    """Log-odds with an informative Dirichlet prior, and the law of the best score of a clean text."""
    begins = counts.select(
        F.explode(F.array(F.col("word"), *[
            F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES])).alias("f"),
        "toxic", "clean").where("f is not null").groupBy("f").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    whole = n_toxic + n_clean
    weight = max(s.least_prior, s.prior_share * whole)
    # Word beginnings sum words, so a document may count more than once; no share exceeds one half here.
    prior = weight * F.least((F.col("t") + F.col("c")) / whole, F.lit(0.5))
    share_t = F.least((F.col("t") + prior) / (n_toxic + weight), F.lit(1.0))
    share_c = F.least((F.col("c") + prior) / (n_clean + weight), F.lit(1.0))
    odds = begins.select("f", "c", F.log(share_t / share_c).alias("d"),
                         F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior)).alias("e"), "t")
    odds = odds.withColumn("low", F.col("d") - s.doubt * F.col("e")).where(
        (F.col("t") >= s.least_docs) & (F.col("low") >= s.least_odds))
    top = odds.orderBy(F.desc("low"), "f").limit(s.max_features).collect()
    scores = {r["f"]: (r["low"], r["d"]) for r in top}
    # Share of clean tokens with each feature; lambda solves E[exp(lambda * score)] = 1 for clean text.
    tokens = counts.agg(F.sum("clean")).first()[0] or 1
    p = np.array([(r["c"] + 0.1) / (tokens + 1) for r in top])
    d = np.array([r["d"] for r in top])
    low, high = 0.0, 50.0
    for _ in range(80):
        middle = (low + high) / 2
        grown = (1 - min(p.sum(), 0.5)) * np.exp(middle * s.drift) + (p * np.exp(np.minimum(middle * d, 500))).sum()
        low, high = (middle, high) if grown < 1 else (low, middle)
    return Model(scores, s.drift, max(low, 1e-3), np.log(0.1), s.significant)


def _evidence_of(texts, model: Model) -> list[tuple[float, float, int]]:
    cache: dict = {}
    out = []
    for text in texts:
        at, scores, n = token_scores(model, cache, text or "")
        best = max((x[2] for x in maximal_segments(at, scores, model.drift)), default=0.0)
        out.append((evidence(model, at, scores, n)[0], best, n))
    return out


def _judged(train: DataFrame, model: Model) -> np.ndarray:
    """(y, evidence, best score, tokens) of the labelled rows."""

    def run(batches):
        for batch in batches:
            e, best, n = zip(*_evidence_of(batch.column(0).to_pylist(), model)) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(e, pa.float64()), pa.array(best, pa.float64()), pa.array(n, pa.int64())],
                names=["y", "e", "best", "n"])

    return train.select("text", "y").mapInArrow(run, "y int, e double, best double, n long").toPandas().sort_values(
        ["y", "e", "best", "n"]).to_numpy(np.float64)


def _with(model: Model, **changes) -> Model:
    return Model(**{**model.__dict__, **changes})


def _log_k(model: Model, rows: np.ndarray) -> float:
    """K by the method of moments, from clean texts that score at all."""
    clean = rows[(rows[:, 0] == 0) & (rows[:, 2] > 0)]
    if len(clean) < 20:
        return model.log_k
    return float((model.scale * clean[:, 2] - np.log(clean[:, 3])).mean() - np.euler_gamma)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y) over x by Newton steps with a weak prior, so that separable data stay finite."""
    design, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column, settings: Settings = Settings(),
                   label_col: str = "toxic") -> Model:
    """Fit on labelled rows: one half's counts judge the other half for the calibration, then all counts are used."""
    rows = labelled_texts(texts_of(docs), labels, label_col, train, settings.max_labelled)
    rows = stored(_one_of_copies(stored(rows, "toxic-labelled")).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "toxic-train")
    sizes = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = {y: [sizes.get((f, y), 0) for f in (0, 1)] for y in (0, 1)}
    if not sum(n[0]) or not sum(n[1]):  # nothing to tell apart: the share of the labels for every text
        share = (sum(n[1]) + 0.5) / (sum(n[0]) + sum(n[1]) + 1)
        return Model({}, settings.drift, 1.0, 0.0, settings.significant, 0.0, float(np.log(share / (1 - share))))
    counts = stored(_word_counts(rows), "toxic-counts")
    parts = []
    for fold in (0, 1):
        model = _model(counts.where(F.col("fold") == fold), n[1][fold], n[0][fold], settings)
        other = rows.where(F.col("fold") != fold)
        model = _with(model, log_k=_log_k(model, _judged(other, model)))
        parts.append((_judged(other, model), model.log_k))
    both = np.concatenate([p[0] for p in parts])
    slope, offset = _logistic(both[:, 1], both[:, 0])
    whole = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model = _model(whole, sum(n[1]), sum(n[0]), settings)
    return _with(model, log_k=float(np.mean([p[1] for p in parts])), slope=slope, offset=offset)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages): calibrated toxicity of every whole text, and its significant passages.

    passages are array<struct<start, end, score, log10_p>> in characters. Every token has the
    log-odds of its word, or of the beginning of its word, between toxic and clean labelled
    texts; all maximal-scoring segments are found in linear time; their p-values follow the
    extreme-value law for the text's length; the best one and the number of significant ones
    give the score by a logistic curve.

    Defined cases: a null or empty text has no passage and the score of a text without any;
    repeated rows score alike; null ids stay; an empty table gives an empty table; further
    columns are ignored. Without labels of both kinds every text gets the share of label 1.
    """
    sent = prepared(docs.sparkSession).sparkContext.broadcast(vars(model))

    def run(batches):
        m, cache = Model(**sent.value), {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
                                   ("log10_p", pa.float64())]))
        for batch in batches:
            values, passages = [], []
            for text in batch.column(1).to_pylist():
                at, scores, n = token_scores(m, cache, text or "")
                e, found = evidence(m, at, scores, n)
                values.append(1 / (1 + np.exp(-np.clip(m.slope * e + m.offset, -30, 30))))
                passages.append([{"start": at[a][1], "end": at[b][2], "score": s, "log10_p": p} for a, b, s, p in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.float64()), pa.array(passages, kind)],
                names=["doc_id", "score", "passages"])

    return texts_of(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, passages array<struct<start:int,end:int,score:double,log10_p:double>>")
