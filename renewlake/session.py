"""Session defaults: UTC dates, adaptive execution, Arrow transfer."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods above 8000 bytes of bytecode. Wide projections (text
    # parsing, feature layers, scenarios) pass that limit; beyond it Spark then generates
    # split methods, which do get compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Settings of the batch queries, for sessions that do not bring their own. Parts that
# tasks sort or hash stay small enough for the memory of one task: with 64 MB of compressed
# rows a part, the sorts of labels and logs spilled several times their input. Joins whose
# parts on one side are small enough to be hashed need no sort at all.
BATCH_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m",
}


def local_session(cpus: int | str = "*", app: str = "renewlake", **conf: str) -> SparkSession:
    """A local session for tests and the bench. Clusters bring their own."""
    shuffle = str(os.cpu_count() or 8) if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.files.openCostInBytes", str(1 << 20))  # small local files still split
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Put the settings the operators rely on onto a session someone else made."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def apply_batch_conf(spark: SparkSession) -> SparkSession:
    """The runtime settings, and the batch settings that the session leaves open."""
    apply_runtime_conf(spark)
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark
