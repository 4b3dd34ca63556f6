"""Classifiers, their comparison, the parameter grid and cross-validation.

All learners are spark.ml estimators (distributed fits).  The labelled
feature table is checkpointed once; preprocessing is fitted once per training
set and shared by every learner of a comparison, and the encoded frame is
persisted, so each learner pass reads cached vectors instead of re-running
the feature job.  Cross-validation fits the preprocessing once per fold, on
that fold's training part (no leakage across folds), and runs the whole grid of
forests on the encoded rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import ceil, log2, sqrt
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.operators.encode import FEATURES, RAW_FEATURES, fit_preprocess, preprocess_stages
from retentia.operators.evaluate import weighted_f1
from retentia.session import scratch_path, written

SEED = 42
# Learner settings of the comparison (raw / refined features).
RF_TREES = 10
LR_ITER, LR_REG, LR_ENET = 10, 0.3, 0.8
GBT_ITER_RAW, GBT_ITER_REFINED = 3, 6
NB_SMOOTHING = 1.0
CLASSIFIERS = ["Random Forest", "Logistic Regression", "Gradient-boosted Tree", "Naive Bayes"]


def learner(name: str, refined: bool = False, features_col: str = FEATURES):
    if name == "Random Forest":
        return RandomForestClassifier(labelCol="label", featuresCol=features_col, numTrees=RF_TREES, seed=SEED)
    if name == "Logistic Regression":
        return LogisticRegression(labelCol="label", featuresCol=features_col, maxIter=LR_ITER, regParam=LR_REG,
                                  elasticNetParam=LR_ENET, family="multinomial")
    if name == "Gradient-boosted Tree":
        return GBTClassifier(labelCol="label", featuresCol=features_col,
                             maxIter=GBT_ITER_REFINED if refined else GBT_ITER_RAW, seed=SEED)
    if name == "Naive Bayes":
        return NaiveBayes(labelCol="label", featuresCol=features_col, smoothing=NB_SMOOTHING,
                          modelType="multinomial")
    raise ValueError(f"unknown classifier {name!r}")


def train_split(data: DataFrame) -> DataFrame:
    return data.where(F.col("split") == "train")


def fit_model(data: DataFrame, name: str, refined: bool = False, handle_invalid: str = "skip",
              assemble_invalid: str = "error", collapse_on: DataFrame | None = None) -> PipelineModel:
    """Preprocessing fitted on the train split + one learner, as one PipelineModel.

    ``collapse_on``: rows the top list of states is fitted on (default: the train split).
    """
    train = train_split(data)
    prep = fit_preprocess(train, refined, handle_invalid, collapse_on, assemble_invalid)
    encoded = prep.transform(train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = learner(name, refined).fit(encoded)
    finally:
        encoded.unpersist()
    return PipelineModel(stages=[*prep.stages, model])


def compare_predictions(data: DataFrame, names: list[str] | None = None, feature_sets=("raw", "refined"),
                        parallelism: int = 4, collapse_on: DataFrame | None = None) -> DataFrame:
    """All learners' predictions in one long table: userId, classifier, features, split, label, prediction.

    Preprocessing is fitted once per feature set on the train split and the
    encoded frame persisted; the independent learner fits are submitted
    concurrently (``parallelism`` driver threads, as CrossValidator does).  The
    table is written below the shared folder, so every metric reads the same
    predictions and no fit is repeated.
    """
    names = names or CLASSIFIERS
    encoded = {}
    for fs in feature_sets:
        prep = fit_preprocess(train_split(data), fs == "refined", collapse_on=collapse_on)
        encoded[fs] = prep.transform(data.where(F.col("split").isin("train", "test"))).persist(
            StorageLevel.MEMORY_AND_DISK)
    tasks = [(fs, name) for fs in feature_sets for name in names]

    def fit(task):
        fs, name = task
        return fs, name, learner(name, fs == "refined").fit(encoded[fs].where(F.col("split") == "train"))

    try:
        with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
            fitted = pool.map(inheritable_thread_target(data.sparkSession)(fit), tasks)
        scored = [model.transform(encoded[fs]).select(
            "userId", F.lit(name).alias("classifier"), F.lit(fs).alias("features"), "split", "label", "prediction")
            for fs, name, model in fitted]
        return written(reduce(DataFrame.unionByName, scored), "predictions")
    finally:
        for df in encoded.values():
            df.unpersist()


def compare_table(predictions: DataFrame) -> DataFrame:
    """classifier, features, train_f1, test_f1 from one grouped aggregate over the long table."""
    return (weighted_f1(predictions, keys=("classifier", "features", "split"))
            .groupBy("classifier", "features").pivot("split", ["train", "test"]).agg(F.first("weighted_f1"))
            .select("classifier", "features", F.col("train").alias("train_f1"), F.col("test").alias("test_f1")))


def compare(data: DataFrame, names: list[str] | None = None, feature_sets=("raw", "refined"),
            parallelism: int = 4, collapse_on: DataFrame | None = None) -> DataFrame:
    """Weighted F1 on train and test for each classifier and feature set."""
    return compare_table(compare_predictions(data, names, feature_sets, parallelism, collapse_on))


# The original grid (3 x 3 x 2 x 3 = 54 combinations).
FULL_GRID = {
    "numTrees": [10, 50, 100],
    "maxDepth": [2, 3, 5],
    "impurity": ["entropy", "gini"],
    "featureSubsetStrategy": ["auto", "sqrt", "log2"],
}
FOLDS = 3


def param_grid(grid: dict | None = None) -> list[dict]:
    """All combinations of the grid (the full one by default), the last name varying fastest."""
    g = grid or FULL_GRID
    return [dict(zip(g, values)) for values in product(*g.values())]


def _forest(params: dict) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", featuresCol=RAW_FEATURES, seed=SEED, **params)


def _same_fit(params: dict, n_features: int) -> tuple:
    """Combinations with one key give one model: the strategies name a number of features per split.

    For a classifier of several trees 'auto' is 'sqrt'; 'sqrt' and 'log2' are rounded up.
    """
    p = dict(params)
    strategy = p["featureSubsetStrategy"]
    if strategy == "auto":
        strategy = "sqrt" if p["numTrees"] > 1 else "all"
    counts = {"sqrt": ceil(sqrt(n_features)), "log2": max(1, ceil(log2(n_features)))}
    p["featureSubsetStrategy"] = counts.get(strategy, strategy)
    return tuple(sorted(p.items()))


def _raw_preprocess(train: DataFrame) -> PipelineModel:
    stages = preprocess_stages(None, refined=False)
    stages[-1].setOutputCol(RAW_FEATURES)
    return Pipeline(stages=stages).fit(train)


GRID_SCHEMA = "combo int, numTrees int, maxDepth int, impurity string, featureSubsetStrategy string"


def cv_scores(data: DataFrame, grid: dict | None = None, folds_col: str = "fold", folds: int = FOLDS,
              parallelism: int = 8) -> DataFrame:
    """Stored table of cross-validated forests on raw features: the grid's columns, fold, f1.

    ``combo`` numbers the combinations in grid order.  Per fold: preprocessing
    fitted on the other folds, both parts encoded and persisted, every distinct
    combination fitted and scored on them (``parallelism`` fits at a time), one
    grouped metric job for all of them, joined with the combinations that share
    a fit.  A fold without rows has no scores.
    """
    spark, train = data.sparkSession, train_split(data)
    combos = param_grid(grid)
    path = scratch_path(spark, "cv-scores")
    schema = f"{GRID_SCHEMA}, fold int, f1 double"
    for fold in range(folds):
        part = train.where(F.col(folds_col) != fold)
        prep = _raw_preprocess(part)
        fit_rows = prep.transform(part).select("label", RAW_FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
        held = prep.transform(train.where(F.col(folds_col) == fold)).select("label", RAW_FEATURES).persist(
            StorageLevel.MEMORY_AND_DISK)

        def fit(params: dict):
            return _forest(params).fit(fit_rows)  # noqa: B023 - used within this fold only

        try:
            first = fit_rows.first()
            keys = [_same_fit(p, len(first[RAW_FEATURES])) for p in combos]
            distinct = dict(zip(reversed(keys), reversed(combos)))
            with ThreadPool(max(1, min(parallelism, len(distinct)))) as pool:
                models = pool.map(inheritable_thread_target(spark)(fit), distinct.values())
            scored = [m.transform(held).select(F.lit(i).alias("fit"), "label", "prediction")
                      for i, m in enumerate(models)]
            place = {k: i for i, k in enumerate(distinct)}
            rows = [(i, int(p["numTrees"]), int(p["maxDepth"]), str(p["impurity"]), str(p["featureSubsetStrategy"]),
                     place[k]) for i, (p, k) in enumerate(zip(combos, keys))]
            (weighted_f1(reduce(DataFrame.unionByName, scored), digits=12, keys=("fit",))
             .join(spark.createDataFrame(rows, f"{GRID_SCHEMA}, fit int"), "fit")
             .select("combo", "numTrees", "maxDepth", "impurity", "featureSubsetStrategy",
                     F.lit(fold).alias("fold"), F.col("weighted_f1").alias("f1"))
             .write.mode("append").parquet(path))
        finally:
            fit_rows.unpersist()
            held.unpersist()
    return spark.read.schema(schema).parquet(path)


def cv_table(scores: DataFrame) -> DataFrame:
    """One row per combination: the grid's columns, f1 (mean over the folds), rank (by f1, ties in grid order)."""
    mean = (scores.groupBy("combo", "numTrees", "maxDepth", "impurity", "featureSubsetStrategy")
            .agg(F.round(F.avg("f1"), 9).alias("f1")))
    return mean.withColumn("rank", F.row_number().over(W.orderBy(F.desc("f1"), "combo")))    # one row per combination


def best_params(results: DataFrame) -> dict:
    """The parameters of rank 1 of ``cv_table``."""
    row = results.where("rank = 1").select("numTrees", "maxDepth", "impurity", "featureSubsetStrategy").first()
    return row.asDict()


def cv_tune(data: DataFrame, grid: dict | None = None, folds_col: str = "fold", folds: int = FOLDS,
            parallelism: int = 8) -> tuple[PipelineModel, DataFrame]:
    """(the best combination fitted on the train split, ``cv_table`` of the grid)."""
    results = cv_table(cv_scores(data, grid, folds_col, folds, parallelism))
    return fit_tuned_forest(data, best_params(results)), results


# The forest that is refitted with its chosen parameters.
TUNED = {"numTrees": 10, "maxDepth": 5, "impurity": "entropy", "featureSubsetStrategy": "sqrt"}


def fit_tuned_forest(data: DataFrame, params: dict | None = None, bootstrap: bool = True) -> PipelineModel:
    """A forest with fixed parameters on the train split's raw features; without bootstrap every tree sees each row once."""
    train = train_split(data)
    prep = _raw_preprocess(train)
    model = _forest(params or TUNED).setBootstrap(bootstrap).fit(prep.transform(train))
    return PipelineModel(stages=[*prep.stages, model])
