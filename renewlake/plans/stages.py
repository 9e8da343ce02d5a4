"""Tables that several queries share, written once per session and input.

The chain clean facts -> member-month snapshot -> labels -> features -> scores is
long; serving queries read its parquet stages instead of planning it again. A
stage is keyed by the application, the input folder and the input files' length
and change time, so replaced input gives a new stage. Lost executors cost nothing:
the lineage ends at the written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from renewlake.sources.scratch import file_stamp, scratch_root

_BUILDERS: dict[str, tuple] = {}  # name -> builder, partition columns and, if the builder gathers the rows itself, True
_DONE: dict[str, tuple[str, T.StructType]] = {}


def stage(name: str, partition_by: tuple[str, ...] = (), gathered: bool = False):
    """Register a builder. It returns the table, or the table and a check to run once it is written.

    With `gathered`, the builder has brought the rows of a partition together itself.
    """
    def register(build):
        _BUILDERS[name] = (build, partition_by, gathered)
        return build

    return register


def input_key(spark: SparkSession, sf_dir: str) -> str:
    stamps = [file_stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem")]
    return hashlib.sha256("|".join([sf_dir, *stamps]).encode()).hexdigest()[:16]


def read_stage(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    build, partition_by, *gathered = _BUILDERS[name]
    path = f"{scratch_root(spark)}/stages/{input_key(spark, sf_dir)}/{name}"
    if path not in _DONE:
        df = build(spark, sf_dir)
        df, check = df if isinstance(df, tuple) else (df, None)
        if partition_by and not any(gathered):
            # Gathers the rows of a month into few files, yet splits a month that is too
            # large for one task (adaptive rebalance).
            df = df.hint("rebalance", *[F.col(c) for c in partition_by])
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        if check:
            check()  # raises before anything reads the stage
        order = [f for f in df.schema.fields if f.name not in partition_by]
        order += [df.schema[c] for c in partition_by]
        _DONE[path] = (path, T.StructType(order))
    path, schema = _DONE[path]
    return spark.read.schema(schema).parquet(path)
