"""Labelled rows for the classifiers: a bounded sample, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, limit: int,
                   id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled rows, those with the least hash of their id.

    `docs` has (doc_id, text). The limit also bounds what is broadcast. Labels other than 0
    and 1 and rows without an id don't count; of rows that repeat an id the larger label does.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(train)
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(F.broadcast(few), "doc_id").select("doc_id", "text", "y")
