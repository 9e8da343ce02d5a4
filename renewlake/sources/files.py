"""File sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from renewlake.sources.schemas import all_strings
from renewlake.sources.scratch import path_exists

CSV_WRITE = {"header": "true", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV, every column as text; empty fields are empty strings."""
    rows = spark.read.schema(all_strings(schema)).option("header", "true").csv(path)
    return rows.na.fill("")


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    """Typed CSV; only the wanted columns are parsed (the reader prunes the rest)."""
    return spark.read.schema(schema).option("header", "true").csv(path).select(*columns)


def read_csv_versions(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Union of the file versions that exist; at least one must."""
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        raise FileNotFoundError(f"none of these sources exists: {paths}")
    return reduce(DataFrame.unionByName, [read_csv_rows(spark, p, schema) for p in present])


def read_parquet_subset(spark: SparkSession, path: str, wanted: dict[str, Column]) -> DataFrame:
    """The wanted columns that exist; the others take their default."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(c) if c in df.columns else default.alias(c) for c, default in wanted.items()])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """zstd parquet; with partitions, rows of one partition value are gathered (and split when large)."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_batch(df: DataFrame, path: str) -> bool:
    """Append unless the batch is empty."""
    if df.isEmpty():
        return False
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return True


def write_month_partitions(df: DataFrame, path: str, date_column: str) -> None:
    month = F.date_format(date_column, "yyyyMM").cast("int")
    write_parquet(df.withColumn("yyyymm", month), path, ("yyyymm",))


def guarded_rebuild(
    spark: SparkSession, rows: DataFrame, path: str, source: str, start: str, end: str, force: bool
) -> str:
    """Write the rows of one source and month range, only over existing ones when forced.

    Rows of other sources and months stay. Months of the range that the new rows no
    longer have are removed as well. New rows of another source or outside [start, end)
    are not written: they would replace partitions that this rebuild isn't about.
    """
    wanted = (
        (F.col("source") == source)
        & (F.col("snapshot_month") >= F.lit(start).cast("date"))
        & (F.col("snapshot_month") < F.lit(end).cast("date"))
    )
    rows = rows.where(wanted)
    if not path_exists(spark, path):
        write_parquet(rows, path, ("source", "snapshot_month"))
        return "written"
    stored = spark.read.parquet(path).where(wanted)
    months = {str(r[0]) for r in stored.select("snapshot_month").distinct().collect()}  # one value per month
    if months and not force:
        return "skipped"
    fresh = {str(r[0]) for r in rows.select("snapshot_month").distinct().collect()}
    (
        rows.hint("rebalance", F.col("source"), F.col("snapshot_month"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("source", "snapshot_month")
        .parquet(path)
    )
    for month in months - fresh:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/source={source}/snapshot_month={month}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return "rebuilt"


def jdbc_profile(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Last flags per member read through JDBC, aggregated inside the database.

    Needs a database and its driver on the class path; the registered query runs the
    same aggregate over a table scan.
    """
    newest = "max(transaction_date)"
    subquery = (
        f"(SELECT t.msno, max(t.is_cancel) AS is_cancel, min(t.is_auto_renew) AS is_auto_renew FROM {table} t "
        f"JOIN (SELECT msno, {newest} AS d FROM {table} GROUP BY msno) l ON l.msno = t.msno AND l.d = t.transaction_date "
        "GROUP BY t.msno) profile"
    )
    return spark.read.format("jdbc").option("url", url).option("dbtable", subquery).options(**options).load()
