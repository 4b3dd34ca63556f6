import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.operators import encode, evaluate, score, train
from retentia.plans.catalog import labelled_of
from retentia.session import scratch_path
from tests.conftest import SF_MID, rows_of


@pytest.fixture(scope="module")
def data(spark):
    return labelled_of(spark, SF_MID).cache()


def test_weighted_f1_unit(spark):
    pairs = [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    df = spark.createDataFrame(pairs, "label double, prediction double")
    ours = evaluate.f1_value(df)
    spark_f1 = MulticlassClassificationEvaluator(metricName="f1").evaluate(df)
    assert abs(ours - 0.6) < 1e-12 and abs(ours - spark_f1) < 1e-12


def test_weighted_f1_grouped_equals_ungrouped(spark):
    pairs = [("a", 1.0, 1.0), ("a", 0.0, 1.0), ("b", 1.0, 1.0), ("b", 0.0, 0.0), ("b", 2.0, 0.0)]
    df = spark.createDataFrame(pairs, "g string, label double, prediction double")
    grouped = dict(rows_of(evaluate.weighted_f1(df, keys=("g",))))
    for g in ("a", "b"):
        assert abs(grouped[g] - evaluate.f1_value(df.where(F.col("g") == g))) < 1e-9


def test_split_is_stable_and_roughly_60_20_20(data):
    counts = dict(rows_of(data.groupBy("split").count()))
    total = sum(counts.values())
    assert set(counts) == {"train", "test", "valid"}
    assert 0.45 < counts["train"] / total < 0.75
    again = rows_of(encode.split_assign(data.drop("bucket", "split")).select("userId", "split"))
    assert again == rows_of(data.select("userId", "split"))


def test_vector_size_is_categories_plus_numbers(data):
    tr = train.train_split(data)
    refined = encode.fit_preprocess(tr, refined=True)
    v = refined.transform(data).select(F.size(vector_to_array("features")).alias("n")).distinct().collect()
    n_states = 11  # ranks 2-11 kept + OTHER
    n_gender = tr.select("gender").distinct().count()
    n_level = tr.select("last_level").distinct().count()
    assert [r.n for r in v] == [n_gender + n_level + n_states + 6]


def test_l1_rows_sum_to_one(data):
    prep = encode.fit_preprocess(train.train_split(data), refined=True)
    s = prep.transform(data).select(F.aggregate(vector_to_array("features"), F.lit(0.0),
                                                lambda a, x: a + F.abs(x)).alias("s"))
    assert s.where(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_same_seed_same_predictions(data):
    a = rows_of(train.fit_model(data, "Random Forest", refined=True).transform(data).select("userId", "prediction"))
    b = rows_of(train.fit_model(data, "Random Forest", refined=True).transform(data).select("userId", "prediction"))
    assert a == b


def test_save_load_same_scores_and_keep_unseen(spark, data):
    model = score.fit_scoring_model(data)
    p = scratch_path(spark, "t-model")
    score.save_model(model, p)
    loaded = score.load_model(p)
    a = rows_of(score.batch_score(model, data))
    b = rows_of(score.batch_score(loaded, data))
    assert a == b and len(a) == data.count()
    unseen = data.limit(3).withColumn("last_state", F.lit("ZZ")).withColumn("gender", F.lit("X"))
    out = score.batch_score(loaded, unseen).collect()
    assert len(out) == 3 and all(r.decision in ("churn", "stay") for r in out)


def test_decision_follows_prediction_column(spark, data):
    model = score.fit_scoring_model(data)
    out = score.batch_score(model, data)
    assert out.where("(prediction = 1.0) <> (decision = 'churn')").count() == 0


def test_naive_bayes_features_are_non_negative(data):
    prep = encode.fit_preprocess(train.train_split(data), refined=True)
    mins = prep.transform(data).select(F.array_min(vector_to_array("features")).alias("m"))
    assert mins.where("m < 0").count() == 0


def test_compare_table_shape(data):
    out = train.compare(data, names=["Naive Bayes", "Random Forest"], feature_sets=("raw", "refined"))
    rows = out.collect()
    assert len(rows) == 4
    assert all(0.0 <= r.train_f1 <= 1.0 and 0.0 <= r.test_f1 <= 1.0 for r in rows)


def test_cv_small_grid(data):
    grid = {"numTrees": [5], "maxDepth": [2, 3], "impurity": ["gini"], "featureSubsetStrategy": ["sqrt"]}
    best, results = train.cv_tune(data, grid=grid, parallelism=2)
    rows = results.collect()
    assert len(rows) == 2 and all(0.0 <= r.f1 <= 1.0 for r in rows)
    top = max(rows, key=lambda r: r.f1)
    assert best.stages[-1].getOrDefault("maxDepth") == top.maxDepth
    assert best.transform(data).count() > 0


def test_full_grid_is_the_default():
    combos = train.param_grid()
    assert len(combos) == 54 and len({tuple(sorted(p.items())) for p in combos}) == 54
    # strategies that name the same number of features give one fit
    assert len({train._same_fit(p, 21) for p in combos}) == 18
    assert len({train._same_fit(p, 100) for p in combos}) == 36


def test_strategies_of_one_fit_give_one_model(data):
    tr = train.train_split(data)
    prep = train._raw_preprocess(tr)
    enc = prep.transform(tr).cache()
    n = len(enc.first()["rawFeatures"])
    params = {"numTrees": 5, "maxDepth": 3, "impurity": "gini"}
    a, b = {**params, "featureSubsetStrategy": "auto"}, {**params, "featureSubsetStrategy": "sqrt"}
    assert train._same_fit(a, n) == train._same_fit(b, n)
    assert train._forest(a).fit(enc).toDebugString.split("\n")[1:] == train._forest(b).fit(enc).toDebugString.split("\n")[1:]


def test_cv_scores_equal_a_plain_fold_loop(data):
    grid = {"numTrees": [5], "maxDepth": [3], "impurity": ["gini"], "featureSubsetStrategy": ["sqrt"]}
    _, results = train.cv_tune(data, grid=grid)
    tr, f1 = train.train_split(data), []
    for fold in range(train.FOLDS):
        model = train.fit_tuned_forest(tr.where(F.col("fold") != fold), train.param_grid(grid)[0])
        held = model.transform(tr.where(F.col("fold") == fold))
        f1.append(MulticlassClassificationEvaluator(metricName="f1").evaluate(held))
    assert abs(results.first().f1 - sum(f1) / len(f1)) < 1e-8


def test_index_policies_skip_keep_error(spark, data):
    tr = train.train_split(data)
    unseen = data.limit(2).withColumn("gender", F.lit("X"))
    assert encode.indexer("skip").fit(tr).transform(unseen).count() == 0
    kept = encode.indexer("keep").fit(tr).transform(unseen).collect()
    n_gender = tr.select("gender").distinct().count()
    assert len(kept) == 2 and all(r.genderIndex == n_gender for r in kept)
    with pytest.raises(Exception):
        encode.indexer("error").fit(tr).transform(unseen).collect()


def test_top_list_fitted_on_all_rows_option(data):
    tr = train.train_split(data)
    on_train = encode.fit_preprocess(tr, refined=True).stages[0].getStatement()
    on_all = encode.fit_preprocess(tr, refined=True, collapse_on=data).stages[0].getStatement()
    assert "OTHER" in on_train and "OTHER" in on_all


def test_scoring_keeps_rows_with_null_numbers(spark, data):
    model = score.fit_scoring_model(data)
    bad = data.limit(2).withColumn("avg_songs", F.lit(None).cast("double"))
    out = score.batch_score(model, bad).collect()
    assert len(out) == 2
    assert all(r.probability is None and r.prediction is None and r.decision is None for r in out)
    nan = data.limit(2).withColumn("avg_songs", F.lit(float("nan")))
    assert all(r.decision is None for r in score.batch_score(model, nan).collect())


def test_train_and_serve_vectors_have_one_size(data):
    size = lambda m, df: {r.n for r in m.transform(df).select(
        F.size(vector_to_array("features")).alias("n")).collect()}
    serve = score.fit_scoring_model(data)
    assert size(train.fit_model(data, "Random Forest", refined=True), data) == size(serve, data)
    unseen = data.limit(1).withColumn("gender", F.lit("X"))
    entries = serve.transform(unseen).select(vector_to_array("genderVec").alias("v")).first().v
    assert len(entries) == data.select("gender").distinct().count() and not any(entries)


def test_top_list_on_all_rows_reaches_the_learners(data):
    on_all = train.fit_model(data, "Naive Bayes", refined=True, collapse_on=data)
    assert on_all.stages[0].getStatement() == encode.fit_preprocess(
        train.train_split(data), refined=True, collapse_on=data).stages[0].getStatement()
