"""A feature frame that breaks its rules is not published."""

import pytest
from pyspark.sql import functions as F

from renewlake.operators import features as X, serving as Q
from renewlake.plans import feature_store as FS, stages
from renewlake.sources import fixtures as fx
from renewlake.sources.scratch import new_path


def written(spark, sf, change_labels=lambda df: df, change_members=lambda df: df):
    frame, check = X.checked_frame(
        change_labels(FS.month_labels(spark, sf)), fx.user_logs(spark, sf), change_members(fx.members(spark, sf)))
    path = new_path(spark, "checked")
    frame.write.parquet(path)
    check()
    return spark.read.parquet(path)


def test_members_that_come_twice_are_one(spark, sf):
    twice = lambda m: m.unionByName(m.withColumn("city", F.lit(0)))
    got = written(spark, sf, change_members=twice)
    assert got.count() == FS.month_labels(spark, sf).count()
    assert X.duplicate_members(got, ("msno", "target_month")).first()["duplicated_keys"] == 0


def test_a_broken_rule_raises(spark, sf):
    late = lambda df: df.withColumn("expire_date", F.lit(20991231).cast(df.schema["expire_date"].dataType))
    with pytest.raises(ValueError, match="days_to_expire_out_of_range"):
        written(spark, sf, change_labels=late)


def test_a_stage_with_a_broken_check_is_not_read(spark, sf):
    def check():
        raise ValueError("broken")

    stages._BUILDERS["broken_stage"] = (lambda spark, sf: (spark.range(3), check), ())
    for _ in range(2):
        with pytest.raises(ValueError, match="broken"):
            stages.read_stage(spark, sf, "broken_stage")
    del stages._BUILDERS["broken_stage"]


def test_sample_is_the_smallest_hashes(spark):
    import hashlib

    names = [f"m{i}" for i in range(3000)] + ["", "é"]
    df = spark.createDataFrame([(n,) for n in names], "msno string").repartition(5)
    order = sorted(names, key=lambda n: (hashlib.md5(n.encode()).hexdigest(), n))
    for limit in (1, 40, 2999, 5000):
        assert [r.msno for r in Q.stable_sample(df, limit).collect()] == order[:limit]
    assert Q.stable_sample(df, None).count() == len(names)
