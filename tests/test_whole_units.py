"""Whole units of the export list do not depend on the order in which amounts were added."""

from renewlake.operators.views import priority_rows


def test_a_half_goes_up_whatever_its_last_bits(spark):
    amounts = {"a": 12.499999999999998, "b": 11.5, "c": 10.500000000000002, "d": 9.4999, "e": 8.0}
    rows = [(name, x, 0.5, x, 1, "Monitor", "driver", "action") for name, x in amounts.items()]
    matrix = spark.createDataFrame(rows, "strategic_segment string, revenue_at_risk double, avg_churn_prob double, "
                                   "avg_future_cltv double, user_count long, quadrant string, primary_risk_driver string, "
                                   "recommended_action string")
    got = priority_rows(matrix).collect()
    assert [(r.strategic_segment, r.revenue_at_risk, r.avg_future_cltv) for r in got] == [
        ("a", 13, 13), ("b", 12, 12), ("c", 11, 11), ("d", 9, 9), ("e", 8, 8)]
