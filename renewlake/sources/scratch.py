"""Where jobs write tables they read back later.

The folder is the one the session names in spark.checkpoint.dir, which every
executor can reach. Only a local session without that setting gets a folder of
its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/renewlake/{context.applicationId}"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_ROOT:
        _LOCAL_ROOT[context.applicationId] = tempfile.mkdtemp(prefix="renewlake-")
    return _LOCAL_ROOT[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch root that nothing has written to yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table below the scratch root, read back: what follows does not compute them again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def file_stamp(spark: SparkSession, path: str) -> str:
    """Length and change time of a file or folder, to notice replaced input."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(hadoop_path)
    return f"{summary.getLength()}:{fs.getFileStatus(hadoop_path).getModificationTime()}"
