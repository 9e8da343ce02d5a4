"""Name -> query. Doubles are rounded at the edge so engines can be compared."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from renewlake.session import apply_batch_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double. The nudge settles values on a rounding half the same way everywhere."""
    nudge = F.lit(10.0 ** -(digits + 3))
    columns = [
        F.round(F.col(f.name) + nudge, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*columns)


def query(key: str, digits: int = 4):
    def register(build):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_batch_conf(spark)
            return rounded(build(spark, sf_dir.rstrip("/")), digits)

        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = run
        return build

    return register
