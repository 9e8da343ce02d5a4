"""What the vector operators share: one row per id, and only usable vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def usable(vec: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def one_per_id(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) with float or double components; of rows that repeat an id the smallest usable vector counts."""
    vec = F.col(vec_col)
    kind = table.schema[vec_col].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):
        vec = vec.cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null")
    return rows.groupBy("vec_id").agg(F.min(F.when(usable(F.col("vec")), F.col("vec"))).alias("vec"))
