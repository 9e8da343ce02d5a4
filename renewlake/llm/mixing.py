"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from renewlake.llm.common import prepared

PIECE_RATE = 500.0  # exp(-rate) is still a normal number
BROADCAST_SOURCES = 100_000


def hashed_unit(*parts: Column) -> Column:
    """A number in (0, 1) from 48 bits of the md5 of the parts, joined by ':'."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def hashed_key(*parts: Column) -> Column:
    """60 bits of the md5 of the parts as a long: a random place in the global order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to a tail far below the 48 bits of the uniform number."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), last), start,
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf")),
        lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, source_col: str = "source", weights: DataFrame | None = None,
                 temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): the mean number of copies of a document of each source.

    The mix holds `epochs` times as many documents as the input, and a source's share of it
    is its weight over the sum of the weights of the sources present. Without a table
    weights(source, weight), a source weighs its size to the power `temperature`. A source
    that the table doesn't name, or with a null or negative weight, weighs nothing.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("s")).agg(F.max("weight").cast("double").alias("w"))
        sizes = (sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left")
                 .select("source", "n", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w")))
    whole = sizes.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    return sizes.crossJoin(F.broadcast(whole)).select(  # one row of totals
        "source", "n", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") * epochs / F.col("n"))
        .otherwise(0.0).alias("rate"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0,
                seed: int = 17, id_col: str = "doc_id", source_col: str = "source",
                payload: bool = True) -> DataFrame:
    """(doc_id, source, rate, copy, shuffle_key[, doc]): every document as often as its Poisson draw says.

    A document's number of copies is the inverse Poisson distribution with its source's rate
    (`source_rates`) at a uniform number that md5 of seed and id fixes. Copies are numbered
    from 1; the result is globally sorted by `shuffle_key`, a hash of seed, id and copy.
    With `payload`, `doc` holds the document's whole row.

    Defined cases: null sources form a source of their own; a null id is drawn as the text
    'null'; rows that repeat an id draw the same number; a rate above 500 is drawn as the sum
    of equal pieces of at most 500, each with a uniform number of its own; null or empty texts
    and further columns don't matter; an empty table gives an empty table.
    """
    prepared(docs.sparkSession)
    rates = source_rates(docs, source_col, weights, temperature, epochs)
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE_RATE).cast("int"), F.lit(1))
    rates = rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), pieces.alias("_pieces"),
                         poisson_cdf(F.col("rate") / pieces).alias("_cdf"))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_of"), name.alias("_name"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if payload else []))
    own = hashed_unit(F.lit(str(seed)), F.col("_name"))
    further = F.transform(
        F.sequence(F.lit(2), F.col("_pieces")),
        lambda i: hashed_unit(F.lit(str(seed)), F.col("_name"), F.lit("piece"), i.cast("string")))
    drawn = rows.join(rates, F.col("_of").eqNullSafe(F.col("_source"))).withColumn(
        "_u", F.when(F.col("_pieces") > 1, F.concat(F.array(own), further)).otherwise(F.array(own)))
    copies = F.aggregate(
        "_u", F.lit(0), lambda n, u: n + F.size(F.filter("_cdf", lambda c: c <= u)))
    counted = drawn.withColumn("_n", copies).where("_n > 0").drop("_cdf", "_u", "_source", "_pieces")
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return each.select(
        F.col("_id").alias("doc_id"), F.col("_of").alias("source"), F.col("_rate").alias("rate"),
        F.col("copy").cast("long").alias("copy"),
        hashed_key(F.lit(str(seed)), F.col("_name"), F.col("copy").cast("string")).alias("shuffle_key"),
        *([F.col("_doc").alias("doc")] if payload else []),
    ).orderBy("shuffle_key", "doc_id")
