"""Training the churn classifier with Spark ML, calibration and importances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from renewlake.functions.cols import clip
from renewlake.operators import boosting
from renewlake.operators.features import numeric_columns
from renewlake.operators.predictive import eval_metrics
from renewlake.sources.scratch import new_path, scratch_root, written

MANY_ROWS = 1_000_000  # a training table of fewer rows has the parts that the session wants
PART_ROWS = 700_000  # the most of an equal part: its file stays below the 128 MB at which a scan splits it
EXCLUDED = ("msno", "is_churn", "transaction_date", "expire_date", "target_month", "last_expire_month",
            "transaction_month", "expire_month")


@dataclass(frozen=True)
class TrainConfig:
    """Boosting runs until `patience` rounds in a row bring no lower validation loss, or `budget` is used up."""

    budget: int = 2000
    patience: int = 100
    max_depth: int = 5
    step_size: float = 0.1
    subsampling: float = 0.85
    feature_share: float = 0.85
    min_instances: int = 120
    max_bins: int = 32
    seed: int = 42


@dataclass(frozen=True)
class Trained:
    features: tuple[str, ...]
    model: GBTClassificationModel
    calibrator: object | None
    raw_metrics: dict
    calibrated_metrics: dict
    use_calibrated: bool
    pos_weight: float
    losses: tuple[float, ...]  # validation log loss after each round that was tried
    best_round: int
    path: str  # where the final model is written


def time_split(frame: DataFrame, valid_month: int, score_month: int) -> dict[str, DataFrame]:
    """Train months before the validation month, both together, and the score month. Empty parts fail."""
    month = F.col("target_month")
    parts = {
        "train": frame.where(month < valid_month),
        "valid": frame.where(month == valid_month),
        "full": frame.where(month <= valid_month),
        "score": frame.where(month == score_month),
    }
    counts = frame.agg(*[F.max(F.when(c, 1)).alias(n) for n, c in (
        ("train", month < valid_month), ("valid", month == valid_month), ("score", month == score_month))]).first()
    if None in counts:
        raise ValueError(f"time split has an empty part: {counts.asDict()}")
    return parts


def select_features(train: DataFrame, score: DataFrame) -> list[str]:
    return [c for c in numeric_columns(train) if c in score.columns and c not in EXCLUDED]


def feature_summary(df: DataFrame, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, mean, variance and non-zero values of many columns, one vector aggregate per group."""
    vectors = VectorAssembler(inputCols=names, outputCol="_v", handleInvalid="keep").transform(df.select(*by, *names))
    summary = Summarizer.metrics("count", "mean", "variance", "numNonZeros").summary(F.col("_v"))
    groups = vectors.groupBy(*by).agg(summary.alias("s"))
    zipped = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"), vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.variance").alias("variance"), vector_to_array("s.numNonZeros").alias("nonzero"))
    return groups.select(*by, F.col("s.count").alias("rows"), F.explode(zipped).alias("r")).select(*by, "rows", "r.*")


def class_weight(train: DataFrame) -> DataFrame:
    positive = F.sum("is_churn")
    negative = F.count(F.lit(1)) - positive
    return train.agg(
        positive.alias("positives"), negative.alias("negatives"),
        F.greatest(negative / F.greatest(positive, F.lit(1)), F.lit(1.0)).alias("scale_pos_weight"))


def _with_probability(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(rows).withColumn("churn_probability_raw", clip(p, 1e-15, 1 - 1e-15)).drop(
        "vector", "rawPrediction", "probability", "prediction", "_weight")


def vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows with their features as a vector; missing values are -1, below all that a feature takes."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features]
    return rows.withColumn("vector", array_to_vector(F.array(*values)))


def even_parts(rows: DataFrame) -> DataFrame:
    """Many rows as equal parts, equally many for each core: every level of every round waits for its slowest task."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    if n < MANY_ROWS:
        return rows.hint("rebalance")
    return rows.repartition(cores * -(-n // (cores * PART_ROWS)))


def _stored_vectors(rows: DataFrame, features: list[str], pos_weight: float, name: str) -> DataFrame:
    """Label, weight and vector as a written table: rounds and stages read it, not the feature job."""
    weight = F.when(F.col("is_churn") == 1, F.lit(pos_weight)).otherwise(F.lit(1.0))
    return written(even_parts(vectors(rows, features).select("is_churn", weight.alias("_weight"), "vector")), name)


def library(cfg: TrainConfig, trees: int) -> GBTClassifier:
    return GBTClassifier(
        labelCol="is_churn", featuresCol="vector", weightCol="_weight", maxIter=trees, maxDepth=cfg.max_depth,
        maxBins=cfg.max_bins, stepSize=cfg.step_size, subsamplingRate=cfg.subsampling,
        featureSubsetStrategy=str(cfg.feature_share), minInstancesPerNode=cfg.min_instances, seed=cfg.seed,
        checkpointInterval=10)


def _fit(rows: DataFrame, cfg: TrainConfig, trees: int) -> GBTClassificationModel:
    """The library's fit; of many rows the same trees, grown on histograms."""
    if rows.count() < MANY_ROWS:
        return library(cfg, trees).fit(rows)
    return boosting.boost(rows, library(cfg, trees), cfg, trees)


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model as it was after some rounds: a longer run starts with the trees of a shorter one."""
    context = SparkContext._active_spark_context
    ml = context._jvm.org.apache.spark.ml
    trees = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    for i, (tree, tree_weight) in enumerate(zip(model.trees[:rounds], model.treeWeights)):
        trees[i], weights[i] = tree._java_obj, tree_weight
    shorter = ml.classification.GBTClassificationModel(f"{model.uid}-{rounds}", trees, weights)
    return GBTClassificationModel(shorter).setFeaturesCol(model.getFeaturesCol())


def boosting_stages(rows: DataFrame, valid: DataFrame, cfg: TrainConfig) -> tuple[GBTClassificationModel, list[float], int]:
    """Model, validation log loss after each round, and the round with the lowest.

    Boosting is deterministic, so a longer run starts with the rounds of a shorter one. The
    first stage runs one round more than the patience. While the best round is less than the
    patience from the end, the next stage is as long as that patience asks; if the best
    round lies in the later half, it has half as many rounds again at least, so that a loss
    that keeps falling costs about three times its last stage.
    """
    rounds = min(cfg.patience + 1, cfg.budget)
    while True:
        model = _fit(rows, cfg, rounds)
        # the library's loss is 2 log(1 + exp(-2 y F)): twice the log loss
        losses = [x / 2 for x in model.evaluateEachIteration(valid)]
        best = min(range(len(losses)), key=lambda i: (losses[i], i)) + 1
        if best + cfg.patience <= rounds or rounds == cfg.budget:
            return model, losses[:min(best + cfg.patience, rounds)], best
        longer = rounds + rounds // 2 if 2 * best > rounds else 0
        rounds = min(max(best + cfg.patience, longer), cfg.budget)


def _calibrate(scored: DataFrame, calibrator) -> DataFrame:
    if calibrator is None:
        return scored.withColumn("churn_probability", F.col("churn_probability_raw"))
    out = calibrator.transform(scored)
    return out.withColumn("churn_probability", clip("_calibrated", 1e-15, 1 - 1e-15)).drop("_calibrated")


def train(frame: DataFrame, valid_month: int, score_month: int, cfg: TrainConfig = TrainConfig()) -> Trained:
    """Early-stopped boosting on the train months, isotonic calibration where it lowers the
    log loss, refit on all labelled months with the number of trees found."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:  # boosting cuts its lineage there every ten trees
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    parts = time_split(frame, valid_month, score_month)
    features = select_features(parts["train"], parts["score"])
    weight = float(class_weight(parts["train"]).first()["scale_pos_weight"])
    # the loss that decides is that of the plain validation rows
    fitted = {name: _stored_vectors(parts[name], features, w, f"train-{name}") for name, w in (("train", weight), ("valid", 1.0))}
    tried, losses, best = boosting_stages(fitted["train"], fitted["valid"], cfg)
    valid = written(_with_probability(first_rounds(tried, best), fitted["valid"]), "valid-scored")
    raw = eval_metrics(valid, prob="churn_probability_raw").first().asDict()
    calibrator, calibrated = None, raw
    if 0.0 < raw["positive_rate"] < 1.0:
        isotonic = IsotonicRegression(labelCol="is_churn", featuresCol="churn_probability_raw", predictionCol="_calibrated")
        candidate = isotonic.fit(valid)
        calibrated = eval_metrics(_calibrate(valid, candidate)).first().asDict()
        if calibrated["log_loss"] < raw["log_loss"]:
            calibrator = candidate
    model = _fit(_stored_vectors(parts["full"], features, weight, "train-full"), cfg, best)
    path = new_path(spark, "model")
    model.write().save(path)
    return Trained(tuple(features), model, calibrator, raw, calibrated, calibrator is not None, weight, tuple(losses), best, path)


def predict(trained: Trained, rows: DataFrame) -> DataFrame:
    return _calibrate(_with_probability(trained.model, vectors(rows, list(trained.features))), trained.calibrator)


def rounds(spark: SparkSession, trained: Trained) -> DataFrame:
    """One row per round that was tried: its validation log loss, and which round the model was cut at."""
    rows = [(i + 1, loss, i + 1 == trained.best_round) for i, loss in enumerate(trained.losses)]
    return spark.createDataFrame(rows, "round long, log_loss double, is_best boolean")


def importances(spark: SparkSession, trained: Trained) -> DataFrame:
    """Gain and number of splits of every feature, from the nodes of the written model.

    A split's gain is its impurity decrease times the weight of the rows that reach it,
    summed over all trees.
    """
    nodes = spark.read.parquet(f"{trained.path}/data").select("nodeData.*").where("leftChild >= 0")
    splits = nodes.groupBy(F.col("split.featureIndex").alias("i")).agg(
        F.sum(F.col("gain") * F.element_at("impurityStats", 1)).alias("gain"), F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame(list(enumerate(trained.features)), "i int, feature string")
    return names.join(splits, "i", "left").select(
        "feature", F.coalesce("gain", F.lit(0.0)).alias("importance_gain"), F.coalesce("n", F.lit(0)).alias("importance_split"))
