"""Boosting on histograms grows the library's trees."""

import random
import re

import numpy as np
import pytest

from renewlake.operators import boosting as B, training as T

NAMES = list("abcdefghi")


@pytest.fixture(scope="module")
def rows(spark):
    """Features of many and few bins, one constant, one copied; labels follow two of them."""
    rnd, found = random.Random(11), []
    for _ in range(4000):
        a, d = rnd.random(), float(rnd.randrange(5))
        y = int(rnd.random() < 0.1 + 0.5 * (a > 0.6) + 0.3 * (d == 2))
        found.append((y, a, rnd.random(), rnd.choice([None, 1.0, a]), d, rnd.gauss(0, 1), float(rnd.randrange(2)), 3.0, a * rnd.random(), d))
    df = spark.createDataFrame(found, "is_churn int, " + ", ".join(f"{n} double" for n in NAMES)).repartition(3)
    return T.written(T.vectors(df, NAMES).selectExpr("is_churn", "if(is_churn = 1, 2.5D, 1D) AS _weight", "vector"), "boosting-rows")


def shape(model):
    """The trees without the predictions, which may differ in the last bits."""
    return [re.sub("Predict: .*", "", tree.toDebugString).split("\n")[1:] for tree in model.trees]


@pytest.mark.parametrize("share, subsampling, depth, least", [(0.85, 0.85, 4, 20), (1.0, 1.0, 3, 20), (0.5, 0.6, 5, 3)])
def test_trees_are_the_librarys(rows, monkeypatch, share, subsampling, depth, least):
    cfg = T.TrainConfig(max_depth=depth, min_instances=least, feature_share=share, subsampling=subsampling)
    want = T.library(cfg, 7).fit(rows)
    monkeypatch.setattr(B, "LINEAGE", 3)  # the state is built again from all trees
    got = B.boost(rows, T.library(cfg, 7), cfg, 7)
    assert shape(got) == shape(want) and got.treeWeights == want.treeWeights
    assert got.numFeatures == want.numFeatures and got.getFeaturesCol() == "vector" and got.getLabelCol() == "is_churn"
    assert got.evaluateEachIteration(rows) == pytest.approx(want.evaluateEachIteration(rows), abs=1e-12)
    p = lambda model: [r[0] for r in T._with_probability(model, rows).select("churn_probability_raw").collect()]
    assert p(got) == pytest.approx(p(want), abs=1e-12)
    assert list(got.featureImportances.toArray()) == pytest.approx(list(want.featureImportances.toArray()), abs=1e-9)
    assert not rows.sparkSession.sparkContext._jsc.getPersistentRDDs()


def test_many_rows_are_fitted_without_the_library(rows, monkeypatch):
    cfg = T.TrainConfig(max_depth=3, min_instances=20)
    want = T._fit(rows, cfg, 3)
    monkeypatch.setattr(T, "MANY_ROWS", 1000)
    monkeypatch.setattr(T.GBTClassifier, "fit", lambda *_: pytest.fail("one scan of all rows for each level"))
    assert shape(T._fit(rows, cfg, 3)) == shape(want)


def test_written_model_has_the_librarys_gains(spark, rows, tmp_path):
    cfg = T.TrainConfig(max_depth=4, min_instances=20)
    found = []
    for name, model in (("own", B.boost(rows, T.library(cfg, 4), cfg, 4)), ("library", T.library(cfg, 4).fit(rows))):
        model.write().save(f"{tmp_path}/{name}")
        trained = T.Trained(tuple(NAMES), model, None, {}, {}, False, 2.5, (), 4, f"{tmp_path}/{name}")
        found.append({r["feature"]: (r["importance_gain"], r["importance_split"]) for r in T.importances(spark, trained).collect()})
    assert found[0].keys() == found[1].keys()
    for name in NAMES:
        assert found[0][name] == (pytest.approx(found[1][name][0], rel=1e-9), found[1][name][1])


def test_draws_are_those_of_the_library(spark):
    jvm = spark.sparkContext._jvm
    for seed in (0, 42, -7, 1 << 40):
        theirs = jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        assert B.uniform(seed, 40).tolist() == [theirs.nextDouble() for _ in range(40)]
        ours, theirs = B.longs(seed), jvm.java.util.Random(seed)
        assert [next(ours) for _ in range(9)] == [theirs.nextLong() for _ in range(9)]
    theirs = jvm.org.apache.spark.util.random.XORShiftRandom(5)
    assert B.uniform(5, 3000)[-1] == [theirs.nextDouble() for _ in range(3000)][-1] and B.uniform(5, 0).tolist() == []


@pytest.mark.parametrize("most", [B.MOST_VALUES, 20])
def test_codes_hold_every_bin(monkeypatch, most):
    """Also where the rows have values that the sample lacks, or so many that a group is taken apart."""
    monkeypatch.setattr(B, "MOST_VALUES", most)
    bins = [32, 1, 2, 5, 32, 3, 40, 2000, 6]
    rnd = np.random.default_rng(2)
    binned = np.stack([rnd.integers(0, n, 3000) for n in bins])
    binned[8] = binned[3] + (binned[3] == 4)
    groups = B.Codes.planned(bins, binned[:, :50])
    codes = B.Codes.of(bins, groups, [np.unique(B.joint_values(binned, members, bins)) for members in groups])
    assert sorted(f for g in codes.groups for f in g) == [0, 2, 3, 4, 5, 6, 7, 8]
    code = codes.encode(binned)
    for f in (0, 2, 3, 4, 5, 6, 7, 8):
        group, table = codes.bin_table(f)
        assert (table[code[group]] == binned[f]).all()
    for g in range(len(codes.groups)):
        table = np.bincount(code[g], minlength=codes.size(g))[None, :]
        for f, part in codes.marginals(g, table):
            assert part[0].tolist() == np.bincount(binned[f], minlength=bins[f]).tolist()


def test_rows_of_a_label_have_one_weight(spark):
    cfg = T.TrainConfig(max_depth=2, min_instances=1)
    df = spark.createDataFrame([(i % 2, 1.0 + (i == 4), float(i)) for i in range(50)], "is_churn int, _weight double, x double")
    with pytest.raises(Exception, match="different weights"):
        B.boost(T.vectors(df, ["x"]), T.library(cfg, 1), cfg, 1)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_no_split_leaves_one_leaf(spark):
    """Constant features, and too few rows for any split."""
    df = spark.createDataFrame([(i % 2, 1.0, 3.0, float(i)) for i in range(30)], "is_churn int, _weight double, x double, y double")
    for names, least in ((["x"], 1), (["x", "y"], 20)):
        cfg, v = T.TrainConfig(max_depth=3, min_instances=least, subsampling=1.0), T.vectors(df, names)
        got, want = B.boost(v, T.library(cfg, 3), cfg, 3), T.library(cfg, 3).fit(v)
        assert shape(got) == shape(want) and got.getNumTrees == 3
        assert got.evaluateEachIteration(v) == pytest.approx(want.evaluateEachIteration(v))
