"""Daily KPI and risk-profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewlake.operators import kpis as K
from renewlake.plans.registry import query
from renewlake.sources import fixtures as fx


@query("transaction_kpi")
def _(spark, sf):
    return K.transaction_kpi(fx.transactions(spark, sf))


@query("activity_kpi")
def _(spark, sf):
    return K.activity_kpi(fx.user_logs(spark, sf))


@query("tx_profile")
def _(spark, sf):
    return K.tx_profile(fx.transactions(spark, sf))


def _risk_features(spark, sf):
    return K.churn_risk_features(fx.user_logs(spark, sf), K.tx_profile(fx.transactions(spark, sf)))


@query("churn_risk_features")
def _(spark, sf):
    return _risk_features(spark, sf)


@query("churn_risk_kpi")
def _(spark, sf):
    return K.churn_risk_kpi(_risk_features(spark, sf))


@query("latest_version_wins")
def _(spark, sf):
    # Version 1 of each day leaves cancellations out; days up to the 20th were loaded again in full.
    tx = fx.transactions(spark, sf)
    first = K.transaction_kpi(tx.where("is_cancel = 0")).withColumn("processed_at", F.lit(1))
    again = K.transaction_kpi(tx).where(F.dayofmonth("event_date") <= 20).withColumn("processed_at", F.lit(2))
    return K.latest_version(first.unionByName(again), ["event_date"])
