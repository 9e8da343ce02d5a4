"""Queries that show the whole of a job of which an older query shows a part."""

import pytest
from check_twins import compare, duck


@pytest.mark.parametrize("key", ["km_pivot", "snapshot_fallback"])
def test_twin(spark, sf, key):
    import __spark_entry__ as entry

    problem, rows = compare(entry.queries()[key](spark, sf), duck(sf), entry.oracle_sql()[key], {})
    assert problem is None and rows > 0


def test_all_dimensions(spark, sf):
    import __spark_entry__ as entry

    found = {r.dimension for r in entry.queries()["km_pivot"](spark, sf).select("dimension").distinct().collect()}
    assert found == {"age_segment", "gender_profile", "txn_freq_bucket", "skip_ratio_bucket"}


def test_history_part_of_the_snapshot(spark, sf):
    import __spark_entry__ as entry

    queries = entry.queries()
    got = {r.month_start: r.total_expiring_users
           for r in queries["snapshot_fallback"](spark, sf).where("given = 'whole'").collect()}
    want = {r.snapshot_month: r.total_expiring_users for r in queries["tab1_kpis"](spark, sf).collect()}
    assert want and {m: got[m] for m in want} == want
