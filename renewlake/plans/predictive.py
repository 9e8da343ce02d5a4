"""Training, scoring and predictive payload queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from renewlake.functions import buckets as B
from renewlake.operators import predictive as V, training as T, views as W
from renewlake.plans.feature_store import features
from renewlake.plans.registry import query
from renewlake.plans.stages import input_key, read_stage, stage
from renewlake.sources import fixtures as fx
from renewlake.sources.scratch import written


def _month(spark, sf, month: int) -> DataFrame:
    return features(spark, sf).where(F.col("target_month") == month)


@stage("scored")
def _scored_stage(spark, sf):
    return V.score_outputs(V.rule_probability(_month(spark, sf, fx.SCORE_MONTH)))


@stage("valid_scored")
def _valid_stage(spark, sf):
    return V.score_outputs(V.rule_probability(_month(spark, sf, fx.VALID_MONTH)))


def scored(spark, sf) -> DataFrame:
    return read_stage(spark, sf, "scored")


def valid_scored(spark, sf) -> DataFrame:
    return read_stage(spark, sf, "valid_scored")


def summary(spark, sf) -> DataFrame:
    return V.segment_risk_summary(scored(spark, sf))


def matrix(spark, sf) -> DataFrame:
    return V.matrix_from_summary(summary(spark, sf))


# --- rules ----------------------------------------------------------------------------

@query("risk_band")
def _(spark, sf):
    return scored(spark, sf).groupBy("churn_probability", B.risk_band("churn_probability").alias("band")).agg(F.count(F.lit(1)).alias("users"))


@query("exec_risk_tier")
def _(spark, sf):
    return scored(spark, sf).groupBy("risk_band", B.risk_tier("risk_band").alias("tier"), B.risk_tier_label("risk_band").alias("label")).agg(
        F.count(F.lit(1)).alias("users"))


@query("driver_from_segments")
def _(spark, sf):
    return scored(spark, sf).groupBy(V.driver().alias("driver"), V.driver(with_skip=False).alias("summary_driver")).agg(
        F.count(F.lit(1)).alias("users"))


@query("recommended_action")
def _(spark, sf):
    rows = scored(spark, sf).select("msno", V.driver().alias("driver"))
    return rows.withColumn("action", V.recommended_action("driver"))


# --- training ---------------------------------------------------------------------------

@query("time_split")
def _(spark, sf):
    parts = T.time_split(features(spark, sf), fx.VALID_MONTH, fx.SCORE_MONTH)
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.min("target_month").alias("first"), F.max("target_month").alias("last"))
        one = one.select(F.lit(name).alias("part"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("feature_select")
def _(spark, sf):
    parts = T.time_split(features(spark, sf), fx.VALID_MONTH, fx.SCORE_MONTH)
    names = T.select_features(parts["train"], parts["score"])
    return T.feature_summary(parts["train"], names).select("feature", "rows", "mean")


@query("class_weight")
def _(spark, sf):
    return T.class_weight(T.time_split(features(spark, sf), fx.VALID_MONTH, fx.SCORE_MONTH)["train"])


_TRAINED: dict[str, T.Trained] = {}


def trained(spark, sf) -> T.Trained:
    """One model per session and input; several queries look at it."""
    key = f"{spark.sparkContext.applicationId}:{input_key(spark, sf)}"
    if key not in _TRAINED:
        _TRAINED[key] = T.train(features(spark, sf), fx.VALID_MONTH, fx.SCORE_MONTH)
    return _TRAINED[key]


@query("train_classifier")
def _(spark, sf):
    rows = T.predict(trained(spark, sf), _month(spark, sf, fx.SCORE_MONTH).drop("is_churn"))
    # ranks read the probabilities several times
    rows = written(rows.select("msno", "target_month", V.AMOUNT, "churn_probability_raw", "churn_probability"), "predicted")
    return V.score_outputs(rows).select("msno", "target_month", "churn_probability_raw", "churn_probability", "risk_percentile", "risk_decile", "risk_band")


@query("training_rounds", digits=6)
def _(spark, sf):
    """Validation loss of every round that was tried before patience ran out."""
    return T.rounds(spark, trained(spark, sf))


@query("isotonic_calibration")
def _(spark, sf):
    t = trained(spark, sf)
    valid = T.predict(t, _month(spark, sf, fx.VALID_MONTH)).select("is_churn", "churn_probability_raw", "churn_probability")
    valid = written(valid, "valid-predicted")  # each metric reads it several times
    raw = V.eval_metrics(valid, prob="churn_probability_raw").withColumn("kind", F.lit("raw"))
    used = V.eval_metrics(valid).withColumn("kind", F.lit("selected"))
    return raw.unionByName(used)


@query("feature_importance_groups")
def _(spark, sf):
    return V.group_importance(T.importances(spark, trained(spark, sf)))


@query("eval_metrics", digits=6)
def _(spark, sf):
    return V.eval_metrics(valid_scored(spark, sf))


@query("score_outputs")
def _(spark, sf):
    return V.score_outputs(V.rule_probability(_month(spark, sf, fx.SCORE_MONTH)))


@query("segment_risk_summary")
def _(spark, sf):
    return summary(spark, sf)


# --- payload -------------------------------------------------------------------------------

@query("value_risk_matrix")
def _(spark, sf):
    members = V.matrix_from_members(scored(spark, sf)).withColumn("basis", F.lit("members"))
    return members.unionByName(matrix(spark, sf).withColumn("basis", F.lit("summary")))


@query("summary_kpis")
def _(spark, sf):
    return V.summary_kpis(matrix(spark, sf))


@query("member_kpis")
def _(spark, sf):
    return V.member_kpis(scored(spark, sf), matrix(spark, sf))


@query("leakage_by_driver")
def _(spark, sf):
    members = V.leakage_from_members(scored(spark, sf)).withColumn("basis", F.lit("members"))
    return members.unionByName(V.leakage_from_matrix(matrix(spark, sf)).withColumn("basis", F.lit("summary")))


@query("risk_band_mix")
def _(spark, sf):
    return V.risk_band_mix(scored(spark, sf))


def importance_proxy(spark, sf) -> DataFrame:
    """Gap of the class means per feature on the train months, a repeatable stand-in for gains."""
    parts = T.time_split(features(spark, sf), fx.VALID_MONTH, fx.SCORE_MONTH)
    names = T.select_features(parts["train"], parts["score"])
    stats = T.feature_summary(parts["train"], names, by=("is_churn",))
    of = lambda label, c: F.max(F.when(F.col("is_churn") == label, F.col(c)))
    two = stats.groupBy("feature").agg(
        *[of(y, c).alias(f"{c}{y}") for y in (0, 1) for c in ("rows", "mean", "variance")], F.sum("nonzero").alias("nonzero"))
    n0, n1 = F.col("rows0"), F.col("rows1")
    gap = F.col("mean1") - F.col("mean0")
    squares = (n0 - 1) * F.col("variance0") + (n1 - 1) * F.col("variance1") + n0 * n1 / (n0 + n1) * gap * gap
    spread = F.sqrt(squares / (n0 + n1))
    return two.select("feature", (F.abs(gap) / (1 + spread)).alias("importance_gain"),
                      F.col("nonzero").cast("long").alias("importance_split"))


@query("feature_waterfall")
def _(spark, sf):
    return V.feature_waterfall(importance_proxy(spark, sf), scored(spark, sf))


def _gains(spark, sf) -> DataFrame:
    return V.feature_waterfall(T.importances(spark, trained(spark, sf)), scored(spark, sf))


@query("feature_waterfall_gains")
def _(spark, sf):
    """The waterfall on the gains of the trained model's splits."""
    return _gains(spark, sf)


@query("waterfall_running_gains")
def _(spark, sf):
    return W.running_waterfall(_gains(spark, sf))


@query("exec_value_risk_matrix")
def _(spark, sf):
    return V.executive_matrix(scored(spark, sf))


@query("exec_value_risk_matrix_all")
def _(spark, sf):
    return V.executive_matrix(scored(spark, sf), filtered_for_display=False)


@query("revenue_sankey")
def _(spark, sf):
    return V.revenue_sankey(scored(spark, sf))


@query("price_paradox")
def _(spark, sf):
    return V.price_paradox(scored(spark, sf))


@query("habit_funnel")
def _(spark, sf):
    return V.habit_funnel(scored(spark, sf))


@query("decay_by_segment")
def _(spark, sf):
    by_price = V.decay_by_price(scored(spark, sf)).withColumn("basis", F.lit("members"))
    return by_price.unionByName(V.decay_of_top_segments(matrix(spark, sf)).withColumn("basis", F.lit("summary")))


@query("loss_outlook")
def _(spark, sf):
    return V.loss_outlook(scored(spark, sf))


@query("prescriptions_top")
def _(spark, sf):
    return V.prescriptions(matrix(spark, sf))


@query("kpis_with_previous")
def _(spark, sf):
    kpis = V.member_kpis(scored(spark, sf), matrix(spark, sf)).select("forecasted_churn_rate", "high_flight_risk_users")
    return V.with_previous(kpis, V.eval_metrics(valid_scored(spark, sf)))


@query("waterfall_running")
def _(spark, sf):
    return W.running_waterfall(V.feature_waterfall(importance_proxy(spark, sf), scored(spark, sf)))


@query("must_save_rollup")
def _(spark, sf):
    return W.must_save_rollup(matrix(spark, sf))


@query("priority_rows")
def _(spark, sf):
    return W.priority_rows(matrix(spark, sf))


@query("top_by_risk")
def _(spark, sf):
    rows = scored(spark, sf)
    band = W.top_by_risk(V.risk_band_mix(rows), "band", "band")
    driver = W.top_by_risk(V.leakage_from_members(rows), "risk_driver", "driver")
    return band.unionByName(driver).unionByName(W.top_by_risk(V.habit_funnel(rows), "habit_stage", "stage"))
