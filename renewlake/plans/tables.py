"""Shared inputs of the registered queries: facts, KPI tables and written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from renewlake.operators import kpis as K, scoring, serving, snapshot as M
from renewlake.plans.stages import read_stage, stage
from renewlake.sources import fixtures as fx


def loaded(kpi: DataFrame) -> DataFrame:
    """KPI rows with a load time one day after their date (fixed, so results repeat)."""
    return kpi.withColumn("processed_at", F.date_add("event_date", 1).cast("timestamp"))


def kpi_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(K.transaction_kpi(fx.transactions(spark, sf_dir)))


def kpi_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(K.activity_kpi(fx.user_logs(spark, sf_dir)))


def kpi_churn_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = tx_profile(spark, sf_dir)
    return loaded(K.churn_risk_kpi(K.churn_risk_features(fx.user_logs(spark, sf_dir), profile)))


@stage("tx_profile")
def _tx_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tx_profile(fx.transactions(spark, sf_dir))


def tx_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored last flags per member, small enough to read again for every micro-batch."""
    return read_stage(spark, sf_dir, "tx_profile")


@stage("snapshot", partition_by=("source", "snapshot_month"))
def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.history_and_realtime(
        fx.transactions(spark, sf_dir), fx.members(spark, sf_dir), fx.user_logs(spark, sf_dir),
        fx.HISTORY_START, fx.REALTIME_START, ("2024-03-01 00:00:00", "2024-03-02 00:00:00"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_with_means(spark, sf_dir).drop("mean_secs")


def snapshot_with_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot and the mean seconds of its members' log rows, which spares a cohort the logs."""
    return read_stage(spark, sf_dir, "snapshot")


@stage("scored_cohort", partition_by=("snapshot_month",))
def _scored_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = serving.model_cohort(snapshot_with_means(spark, sf_dir), fx.transactions(spark, sf_dir))
    return scoring.score_members(cohort)


def scored_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stage(spark, sf_dir, "scored_cohort")


@stage("raw_transactions")
def _raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.raw_transactions(spark, sf_dir)


@stage("raw_user_logs")
def _raw_user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.raw_user_logs(spark, sf_dir)


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty text rows as they were landed."""
    return read_stage(spark, sf_dir, "raw_transactions")


def raw_user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stage(spark, sf_dir, "raw_user_logs")
