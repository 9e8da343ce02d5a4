"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from renewlake.session import apply_runtime_conf
from renewlake.sources.scratch import new_path

# What ASCII counts as white space: the class [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"

# Rows per Arrow batch. Documents can be long, so a worker should hold few of them.
ARROW_ROWS = "500"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators of this folder rely on."""
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             carry: Sequence[str] | None = None) -> DataFrame:
    """Id and text under fixed names; the columns to carry along are packed into `doc`, so no name can clash."""
    packed = [] if carry is None else [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *packed)


def crc_mod(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number: the folds of the labelled rows."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % modulus


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
