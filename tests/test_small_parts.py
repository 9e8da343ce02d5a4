"""Shared steps keep their parts small: settings, narrow rows in exchanges."""

from renewlake import session
from renewlake.operators import features as X
from renewlake.plans import feature_store as FS
from renewlake.sources import fixtures as fx


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "5m")
        session.apply_batch_conf(spark)
        assert spark.conf.get(key) == "5m"
        spark.conf.unset(key)
        session.apply_batch_conf(spark)
        assert spark.conf.get(key) == session.BATCH_CONF[key]
    finally:
        spark.conf.set(key, before or session.BATCH_CONF[key])


def test_the_stage_exchanges_rows_before_they_grow(spark, sf):
    frame, _ = X.checked_frame(FS.month_labels(spark, sf), fx.user_logs(spark, sf), fx.members(spark, sf))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Rebalance" in line)
    assert not any("bi_segment_name" in line for line in lines[at:])  # a column of the last layer
