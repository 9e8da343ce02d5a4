"""Cases that once went wrong."""

from pyspark.sql import functions as F

from renewlake.functions.cols import parse_float, parse_int
from renewlake.sources.files import guarded_rebuild


def test_numbers_are_decimal(spark):
    words = ["12d", "1.5f", "0x1p3", "1D", " 12 ", "-1.5e2", ".5", "7.", "", None, "abc", "--1"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = [tuple(r) for r in rows.select(parse_float("w"), parse_int("w")).collect()]
    assert got == [(None, None)] * 4 + [(12.0, 12), (-150.0, -150), (0.5, 0), (7.0, 7)] + [(None, None)] * 4


def test_rebuild_leaves_other_partitions(spark, tmp_path):
    def rows(*triples):
        return spark.createDataFrame(triples, "source string, snapshot_month string, x int").withColumn(
            "snapshot_month", F.to_date("snapshot_month"))

    path = str(tmp_path / "snapshots")
    every = rows(("a", "2023-01-01", 1), ("b", "2023-01-01", 2), ("a", "2023-05-01", 3))
    for source, start, end in (("a", "2023-01-01", "2024-01-01"), ("b", "2023-01-01", "2024-01-01")):
        guarded_rebuild(spark, every, path, source, start, end, True)
    stray = rows(("a", "2023-01-01", 10), ("b", "2023-01-01", 20), ("a", "2023-05-01", 30))
    guarded_rebuild(spark, stray, path, "a", "2023-01-01", "2023-02-01", True)
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("source", F.col("snapshot_month").cast("string"), "x").collect())
    assert got == [("a", "2023-01-01", 10), ("a", "2023-05-01", 3), ("b", "2023-01-01", 2)]
