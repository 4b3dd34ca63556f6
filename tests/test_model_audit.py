"""Fitted models held against independent computations: node tables, optimality, stored scores and predictions."""

import duckdb
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.operators import encode, evaluate, optimality, rows, score, train, trees
from retentia.plans.catalog import labelled_of
from retentia.schema import EVENT, FEATURE_COLUMNS, FEATURES
from retentia.session import written
from retentia.sources import io
from tests.conftest import SF_MID, SF_SMALL, T

# Weighted F1 per group of a stored prediction table, in SQL that shares nothing with the library.
F1_SQL = """WITH p AS (SELECT {keys}, label, prediction FROM read_parquet('{path}/*.parquet')),
cls AS (SELECT DISTINCT {keys}, label AS c FROM p),
m AS (SELECT {ckeys}, cls.c, sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS support,
  sum(CASE WHEN label = c AND prediction = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN prediction = c THEN 1 ELSE 0 END) AS said
  FROM cls JOIN p USING ({keys}) GROUP BY ALL)
SELECT {keys}, sum(support * CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (support + said) END) / sum(support) AS f1
FROM m GROUP BY {keys}"""


def sql_f1(table, keys):
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    names = keys.split(", ")
    sql = F1_SQL.format(keys=keys, ckeys=", ".join(f"cls.{k}" for k in names), path=path)
    return {r[:-1]: r[-1] for r in duckdb.sql(sql).fetchall()}


@pytest.fixture(scope="module")
def data(spark):
    return labelled_of(spark, SF_MID)


@pytest.fixture(scope="module")
def encoded(data):
    prep = encode.fit_preprocess(train.train_split(data), refined=True)
    return written(prep.transform(data).select("userId", "split", "label", "features"), "encoded")


def test_boosted_trees_walked_equal_the_model(encoded):
    model = train.learner("Gradient-boosted Tree", True).fit(train.train_split(encoded))
    want = {r.userId: (r.m, r.prediction) for r in model.transform(encoded).select(
        "userId", vector_to_array("rawPrediction")[1].alias("m"), "prediction").collect()}
    got = {r.userId: (r.margin, r.prediction) for r in trees.boosted_scores(encoded, trees.node_table(model)).collect()}
    assert set(got) == set(want) and len(want) > 100
    assert all(abs(got[u][0] - want[u][0]) < 1e-9 and got[u][1] == want[u][1] for u in want)


def test_forest_walked_equals_the_model(encoded):
    model = train.learner("Random Forest", True).fit(train.train_split(encoded))
    want = {r.userId: (list(r.p), r.prediction) for r in model.transform(encoded).select(
        "userId", vector_to_array("probability").alias("p"), "prediction").collect()}
    got = {r.userId: (r.probability, r.prediction) for r in trees.forest_scores(encoded, trees.node_table(model)).collect()}
    assert set(got) == set(want)
    for u, (p, y) in want.items():
        assert got[u][1] == y and max(abs(a - b) for a, b in zip(p, got[u][0])) < 1e-9


def test_tree_of_one_leaf(spark, encoded):
    model = train.learner("Random Forest").setMaxDepth(0).fit(train.train_split(encoded))
    got = trees.forest_scores(encoded, trees.node_table(model))
    assert got.select("prediction").distinct().count() == 1 and got.count() == encoded.count()


@pytest.mark.parametrize("kind", ["entropy", "gini"])
def test_every_split_of_the_fixed_forest(data, kind):
    params = train.TUNED | {"impurity": kind}
    model = train.fit_tuned_forest(data, params, bootstrap=False)
    seen = model.transform(train.train_split(data)).select("userId", "label", encode.RAW_FEATURES)
    nodes = trees.node_table(model.stages[-1])
    audit = trees.split_audit(seen, nodes, kind, features=encode.RAW_FEATURES).collect()
    assert len(audit) == nodes.where("left >= 0").count() > 20
    for r in audit:
        assert abs(r.impurity - r.impurity_of_rows) < 1e-9 and abs(r.gain - r.gain_of_rows) < 1e-9
        assert r.best_gain <= r.gain_of_rows + 1e-9 and r.n >= 2
    assert {r.tree for r in audit} == set(range(params["numTrees"]))


def test_bootstrap_forest_does_not_pass_the_audit(data):
    model = train.fit_tuned_forest(data)
    seen = model.transform(train.train_split(data)).select("userId", "label", encode.RAW_FEATURES)
    audit = trees.split_audit(seen, trees.node_table(model.stages[-1]), "entropy", features=encode.RAW_FEATURES).collect()
    assert any(abs(r.impurity - r.impurity_of_rows) > 1e-6 for r in audit)


def test_optimality_holds_for_fits_and_fails_for_others(spark, encoded):
    rows_ = train.train_split(encoded).select("label", "features")
    for reg, enet in ((0.3, 0.8), (0.02, 0.5), (0.01, 0.0)):
        fit = train.learner("Logistic Regression", True).setRegParam(reg).setElasticNetParam(enet).setMaxIter(500).setTol(1e-10)
        out = optimality.optimality(fit.fit(rows_), rows_).collect()
        assert all(r.optimal for r in out) and len(out) == 2 * (1 + max(r.i for r in out))
    assert any(r.coefficient != 0 for r in out)
    early = train.learner("Logistic Regression", True).setRegParam(0.001).setElasticNetParam(0.0).setMaxIter(1).fit(rows_)
    assert not all(r.optimal for r in optimality.optimality(early, rows_).collect())


def test_optimality_with_weights_that_are_not_zero(spark):
    small = labelled_of(spark, SF_SMALL)
    prep = encode.fit_preprocess(train.train_split(small), refined=True)
    rows_ = prep.transform(train.train_split(small)).select("label", "features")
    out = optimality.optimality(train.learner("Logistic Regression", True).setMaxIter(300).setTol(1e-10).fit(rows_), rows_)
    assert out.where("coefficient <> 0").count() > 0 and out.where("not optimal").count() == 0


def test_f1_of_all_learners_from_one_stored_table(data):
    table = train.compare_predictions(data)
    want = sql_f1(table, "classifier, features, split")
    got = {(r.classifier, r.features): r for r in train.compare_table(table).collect()}
    assert len(got) == 8 and len(want) == 16
    for (c, f, split), f1 in want.items():
        assert abs(getattr(got[c, f], f"{split}_f1") - f1) < 1e-8


def test_cross_validation_table_from_the_stored_scores(data):
    grid = {"numTrees": [5, 10], "maxDepth": [2, 3], "impurity": ["gini"], "featureSubsetStrategy": ["auto", "sqrt"]}
    scores = train.cv_scores(data, grid)
    assert scores.count() == 8 * 3
    path = scores.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    want = {r[0]: r[1:] for r in duckdb.sql(
        f"SELECT combo, round(avg(f1), 9), row_number() OVER (ORDER BY round(avg(f1), 9) DESC, combo) "
        f"FROM read_parquet('{path}/*.parquet') GROUP BY combo").fetchall()}
    results = train.cv_table(scores)
    got = {r.combo: (r.f1, r.rank) for r in results.collect()}
    assert got.keys() == want.keys() and all(abs(got[c][0] - want[c][0]) < 1e-9 and got[c][1] == want[c][1] for c in want)
    combos = train.param_grid(grid)
    best = min(got, key=lambda c: (-got[c][0], c))
    assert train.best_params(results) == combos[best]
    # 'auto' and 'sqrt' are one fit: equal scores, the first in grid order ranks before the other
    assert got[0][0] == got[1][0] and got[0][1] < got[1][1]


def test_tuned_model_per_split(data):
    model = train.fit_tuned_forest(data)
    table = written(model.transform(data).select("userId", "split", "label", "prediction"), "tuned")
    want = sql_f1(table, "split")
    got = {(r.split,): r.weighted_f1 for r in evaluate.weighted_f1(table, keys=("split",)).collect()}
    assert got.keys() == want.keys() == {("train",), ("test",), ("valid",)}
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_request_rows_from_forms(spark, data):
    users = data.select(*[c for c in FEATURE_COLUMNS if c != "churn"])
    forms = users.select([F.col(c).cast("string").alias(c.upper()) for c in users.columns]).withColumns(
        {"LAST_LEVEL": F.initcap("LAST_LEVEL"), "comment": F.lit("x")})
    back = io.request_rows(forms)
    assert back.schema.simpleString() == FEATURES.simpleString()
    assert back.drop("churn").exceptAll(users).count() == 0 and back.count() == users.count()
    typed = io.request_frame(spark, [{**r.asDict(), "last_level": r.last_level.capitalize()} for r in users.limit(5).collect()])
    model = score.fit_scoring_model(data, "Naive Bayes")
    a = {r.userId: r.prediction for r in score.batch_score(model, back).collect()}
    assert all(a[r.userId] == r.prediction for r in score.batch_score(model, typed).collect())
    bad = io.request_rows(spark.createDataFrame([("u", "F", "many"), (None, None, None)], "userId string, gender string, thumbs_up string"))
    assert [r.thumbs_up for r in bad.collect()] == [None, None]
    assert all(r.decision is None for r in score.batch_score(model, bad).collect())
    assert score.batch_score(model, back.limit(0)).count() == 0


def test_one_user_at_one_ts_is_spread_over_tasks(spark):
    hot = [("u0", "Home", T, "paid", "F", None)] * 3000
    rest = [(f"u{i % 500 + 1}", "Home", T + i, "free", "F", None) for i in range(6000)]
    log = spark.createDataFrame(hot + rest, EVENT).repartition(16)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                          "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        out = rows.mark_last_rows(log)
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        mine = [r["count"] for r in out.where("userId = 'u0'").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 9000 and sum(mine) == 3000
    assert len(mine) >= 5 and max(mine) < 1500 and max(per_task) < 2200
    assert out.where("userId = 'u0' and last_level = 'paid'").count() == 3000
