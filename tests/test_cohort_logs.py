"""The scored cohort takes the listening from the snapshot."""

import datetime as dt

from pyspark.sql import functions as F

from renewlake.operators import serving as Q, snapshot as M
from renewlake.plans import tables as tb
from renewlake.sources import fixtures as fx


def test_a_cohort_needs_no_second_read_of_the_logs(spark, sf):
    tx, logs, people = fx.transactions(spark, sf), fx.user_logs(spark, sf), fx.members(spark, sf)
    # a member without seconds in one month: their mean is unknown, not 0 over their rows
    day = dt.date(2023, 5, 9)
    gap = logs.limit(1).withColumns({"msno": F.lit("x"), "date": F.lit(day), "total_secs": F.lit(None).cast("double")})
    paid = tx.limit(1).withColumns({"msno": F.lit("x"), "membership_expire_date": F.lit(day)})
    logs, tx = logs.unionByName(gap), tx.unionByName(paid)
    snapshot = M.history_and_realtime(tx, people, logs, fx.HISTORY_START, fx.REALTIME_START, ("2024-03-01", "2024-03-02"))
    carried, read = (Q.model_cohort(snapshot, tx, *given) for given in ((), (logs,)))
    assert carried.columns == read.columns
    key = lambda r: (r.msno, r.snapshot_month)
    one, two = (sorted(df.collect(), key=key) for df in (carried, read))
    assert len(one) == len(two) > 0
    for a, b in zip(one, two):
        assert abs(a.avg_daily_secs - b.avg_daily_secs) <= 1e-9 * (1 + b.avg_daily_secs)
        assert a[:9] == b[:9]
    assert "mean_secs" not in tb.snapshot(spark, sf).columns
