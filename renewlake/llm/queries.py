"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from renewlake.llm import (bpe, line_dedup, mixing, multi_index, ngram_join, periods, phrases, pii, quality,
                           site_tree, substrings, topk, toxicity)
from renewlake.llm.common import crc_mod, read_table
from renewlake.llm.vectors import one_per_id

QUERIES = {}

# Users pass their own secret; the registered query's is fixed so that its result is.
PII_KEY = b"surrogates of the registered query"


def byte_bpe_file() -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "copy", "shuffle_key", "doc.text")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels, crc_mod("doc_id", 3) != 1)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")


def token_digests(encoded: DataFrame) -> DataFrame:
    """Number of tokens, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode(read_table(spark, sf_dir, "documents"), byte_bpe_file(), decoded=True))


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_per_id(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    whole = rows.select("vec_id", F.transform("vec", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))
    return topk.top_inner_products(whole, F.col("vec_id") % 50 == 0)


@query
def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = quality.train_quality(docs, labels, crc_mod("doc_id", 5) != 0)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(read_table(spark, sf_dir, "documents"), PII_KEY)


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_tree.main_texts(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The documents of op13: every tenth, by crc32 of its id, repeats a stretch of its words up to its end.

    With h the checksum, g = floor(h / 10) and n words, the words from a = g mod n on become
    the first p = 1 + floor((n - a) / (3 + g mod 8)) of them, over and over.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    split = F.split(F.when(h % 10 == 0, F.col("text")), r"[\x20\x09-\x0D]+")  # null for the other nine
    words = docs.select("doc_id", "text", F.filter(split, lambda w: w != "").alias("words"), F.floor(h / 10).alias("g"))
    counted = words.withColumn("n", F.when(F.size("words") > 0, F.size("words")))
    cut = counted.withColumn("a", (F.col("g") % F.col("n")).cast("int")).withColumn(
        "p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(again, 1, rest)), " ")
    return cut.select("doc_id", F.coalesce(text, "text").alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse_runs(with_planted_periods(read_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.short")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
