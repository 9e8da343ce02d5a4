"""Boosting in stages with patience, and what is read from the written model."""

import random

import pytest
from pyspark.sql import functions as F

from renewlake.operators import training as T


@pytest.fixture(scope="module")
def frame(spark):
    """Churn follows x, with noise; y is noise, z has missing values."""
    rnd, rows = random.Random(4), []
    for i in range(1500):
        x = rnd.random()
        month = rnd.choice([202401, 202402, 202403])
        rows.append((f"m{i}", month, int(rnd.random() < 0.1 + 0.7 * (x > 0.6)), x, rnd.random(), rnd.choice([None, 1.0, x])))
    return spark.createDataFrame(rows, "msno string, target_month int, is_churn int, x double, y double, z double")


CFG = T.TrainConfig(budget=60, patience=6, max_depth=3, min_instances=20, feature_share=1.0)


@pytest.fixture(scope="module")
def trained(frame):
    return T.train(frame, 202402, 202403, CFG)


def test_stops_by_patience_at_the_lowest_loss(trained):
    losses = trained.losses
    assert trained.best_round == min(range(len(losses)), key=lambda i: losses[i]) + 1
    assert len(losses) == trained.best_round + CFG.patience < CFG.budget
    assert trained.model.getNumTrees == trained.best_round
    assert min(losses) < losses[0]


def test_stages_do_not_depend_on_their_lengths(frame, trained):
    """One long run gives the losses that the stages gave."""
    parts = T.time_split(frame, 202402, 202403)
    features = T.select_features(parts["train"], parts["score"])
    rows = [T._stored_vectors(parts[p], features, w, p) for p, w in (("train", trained.pos_weight), ("valid", 1.0))]
    model = T._fit(rows[0], CFG, 30)
    long = [x / 2 for x in model.evaluateEachIteration(rows[1])]
    n = min(30, len(trained.losses))
    assert long[:n] == pytest.approx(trained.losses[:n])
    # the loss is the log loss of the unweighted rows
    last = T._with_probability(model, T.vectors(parts["valid"], features)).select(
        F.avg(-F.when(F.col("is_churn") == 1, F.log("churn_probability_raw")).otherwise(F.log1p(-F.col("churn_probability_raw")))))
    assert last.first()[0] == pytest.approx(long[-1], rel=1e-6)


def test_budget_is_an_end(frame):
    short = T.train(frame, 202402, 202403, T.TrainConfig(budget=3, patience=50, max_depth=2, min_instances=20))
    assert len(short.losses) == 3 and 1 <= short.best_round <= 3


def test_gains_are_those_of_the_nodes(spark, trained):
    """Split counts and gains against a walk through the model's trees."""
    want = {}

    def walk(node):
        if node.getClass().getSimpleName() == "InternalNode":
            name = trained.features[node.split().featureIndex()]
            gain, n = want.get(name, (0.0, 0))
            want[name] = gain + node.gain() * node.impurityStats().stats()[0], n + 1
            walk(node.leftChild())
            walk(node.rightChild())

    for tree in trained.model.trees:
        walk(tree._java_obj.rootNode())
    got = {r["feature"]: (r["importance_gain"], r["importance_split"]) for r in T.importances(spark, trained).collect()}
    assert set(got) == set(trained.features) and got["x"][0] > got["y"][0]
    for name, (gain, n) in got.items():
        assert (gain, n) == (pytest.approx(want.get(name, (0.0, 0))[0]), want.get(name, (0.0, 0))[1])


def test_predictions(frame, trained):
    rows = T.predict(trained, frame.where("target_month = 202403").drop("is_churn"))
    high, low = (rows.where(c).agg(F.avg("churn_probability")).first()[0] for c in ("x > 0.7", "x < 0.5"))
    assert high > 0.5 > low and rows.where("churn_probability <= 0 OR churn_probability >= 1").count() == 0
    assert "vector" not in rows.columns and rows.count() == frame.where("target_month = 202403").count()
