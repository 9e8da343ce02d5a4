"""Training: a shorter model without a fit of its own, equal parts, one scoring of the validation rows."""

import random

import pytest

from renewlake.operators import training as T

CFG = T.TrainConfig(budget=20, patience=20, max_depth=3, min_instances=20, feature_share=1.0)


@pytest.fixture(scope="module")
def frame(spark):
    rnd, rows = random.Random(7), []
    for i in range(900):
        x = rnd.random()
        rows.append((f"m{i}", rnd.choice([202401, 202402, 202403]), int(rnd.random() < 0.2 + 0.5 * (x > 0.5)), x, rnd.choice([None, x, 2.0])))
    return spark.createDataFrame(rows, "msno string, target_month int, is_churn int, x double, y double")


def test_first_rounds_are_the_shorter_run(frame):
    rows = T._stored_vectors(frame, ["x", "y"], 2.0, "rounds")
    longer = T._fit(rows, CFG, 9)
    for n in (1, 4, 9):
        cut = T.first_rounds(longer, n)
        assert cut.getNumTrees == n and cut.treeWeights == longer.treeWeights[:n]
        assert T._with_probability(cut, rows).collect() == T._with_probability(T._fit(rows, CFG, n), rows).collect()


def test_train_fits_the_stages_and_the_final_model_only(frame, monkeypatch):
    """One fit of the budget, one of all months; none to get back to the best round."""
    fits, fit = [], T._fit

    def counted(rows, cfg, trees):
        fits.append(trees)
        return fit(rows, cfg, trees)

    monkeypatch.setattr(T, "_fit", counted)
    trained = T.train(frame, 202402, 202403, CFG)
    assert trained.best_round < CFG.budget
    assert fits == [CFG.budget, trained.best_round]
    assert not frame.sparkSession.sparkContext._jsc.getPersistentRDDs()  # no vectors kept in memory


def test_many_rows_come_in_equal_parts(frame, monkeypatch):
    cores = frame.sparkSession.sparkContext.defaultParallelism
    monkeypatch.setattr(T, "MANY_ROWS", 500)
    sizes = lambda: [len(p) for p in T.even_parts(frame).rdd.glom().collect()]
    one_each = sizes()
    monkeypatch.setattr(T, "PART_ROWS", 100)
    more = sizes()
    assert len(one_each) == cores and len(more) == cores * -(-900 // (cores * 100))
    for found in (one_each, more):
        assert sum(found) == 900 and max(found) <= 1.2 * 900 / len(found) + cores


def test_queries_read_their_predictions_from_a_table(spark, frame, monkeypatch):
    """Ranks and metrics read the probabilities several times; the trees are walked once."""
    from pyspark.sql import functions as F

    from renewlake.plans import predictive as P
    from renewlake.plans.registry import QUERIES

    rows = frame.withColumn("expected_renewal_amount", F.lit(10.0))
    trained = T.train(frame, 202402, 202403, T.TrainConfig(budget=2, max_depth=2, min_instances=20))
    monkeypatch.setattr(P, "trained", lambda spark, sf: trained)
    monkeypatch.setattr(P, "_month", lambda spark, sf, month: rows.where(F.col("target_month") == month))
    scored = QUERIES["train_classifier"](spark, "unused")
    assert any("predicted-" in f for f in scored.inputFiles())
    assert scored.count() == frame.where(F.col("target_month") == P.fx.SCORE_MONTH).count()
    metrics = QUERIES["isotonic_calibration"](spark, "unused")
    assert any("valid-predicted-" in f for f in metrics.inputFiles())
    found = {r["kind"]: r for r in metrics.collect()}
    direct = P.V.eval_metrics(T.predict(trained, rows.where(F.col("target_month") == P.fx.VALID_MONTH))).first()
    assert found["selected"]["log_loss"] == pytest.approx(direct["log_loss"], abs=1e-4)
