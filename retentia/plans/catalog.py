"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables (through the activity adapter) in full;
none runs on a sample, an id subset or fixed input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.columns import event_date, state_of
from retentia.operators import category, encode, evaluate, label, optimality, profile, rows, score, train, trees
from retentia.operators import features as feat
from retentia.schema import FEATURE_COLUMNS
from retentia.session import materialize, scratch_path
from retentia.sources import io
from retentia.sources.activity import activity_log, activity_parts, event_facts, user_profile, with_users
from retentia.streaming import features_from_partials, start_partials_stream

Query = Callable[[SparkSession, str], DataFrame]

LOG_ORDER = ["ts", "userId", "page", "level", "gender", "location"]
HEAD_N = 20
TAIL_N = 2
TOP_K, TOP_SKIP = 10, 1


# -- inputs ------------------------------------------------------------------

def facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without profile columns: no query that does not need them joins the customers."""
    return activity_parts(spark, sf_dir)[0]


def clean_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.drop_blank_users(facts_of(spark, sf_dir))


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, users = activity_parts(spark, sf_dir)
    return feat.feature_table(facts, users=users)


def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.drop_blank_users(activity_log(spark, sf_dir))


# -- feature table -------------------------------------------------------------

def q_feature_table(spark, sf_dir):
    """Flagship: facts reduced per (user, day) then per user; profile joined per user."""
    return features_of(spark, sf_dir)


def q_feature_table_rowlog(spark, sf_dir):
    """Same table from the row-level log (profile columns on every event)."""
    return feat.feature_table(activity_log(spark, sf_dir))


def q_feature_table_joinform(spark, sf_dir):
    facts, users = activity_parts(spark, sf_dir)
    return feat.feature_table_joinform(facts, users=users)


def q_stream_feature_table(spark, sf_dir):
    """Log files (as written by their tasks) replayed as a stream; table from the partials."""
    facts, users = activity_parts(spark, sf_dir)
    source = scratch_path(spark, "stream-source")
    facts.write.parquet(source)
    sink, ckpt = scratch_path(spark, "stream-partials"), scratch_path(spark, "stream-checkpoint")
    query = start_partials_stream(spark, source, sink, ckpt, schema=facts.schema, with_profile=False)
    query.awaitTermination()
    return features_from_partials(spark, sink, users=users)


# -- sources and sinks ---------------------------------------------------------

def q_activity_scan(spark, sf_dir):
    return activity_log(spark, sf_dir)


def q_events_json_scan(spark, sf_dir):
    """Log written as JSON lines, read back with the declared EVENT schema."""
    path = scratch_path(spark, "events-json")
    io.write_events(activity_log(spark, sf_dir), path, fmt="json")
    return io.read_events(spark, path, fmt="json")


def q_feature_csv_roundtrip(spark, sf_dir):
    """Headerless CSV sink (one part file per task), read back as a directory by position."""
    path = scratch_path(spark, "features-csv")
    io.write_features(features_of(spark, sf_dir), path, header=False)
    return io.read_features(spark, path, header=False)


def q_feature_csv_header_scan(spark, sf_dir):
    path = scratch_path(spark, "features-csv-header")
    io.write_features(features_of(spark, sf_dir), path, header=True)
    return io.read_features(spark, path, header=True)


def q_request_log_append(spark, sf_dir):
    """Two request batches appended to one parquet log, read back whole."""
    path = scratch_path(spark, "requests")
    ft = materialize(features_of(spark, sf_dir))  # one feature job for both batches
    io.append_requests(ft.where(F.col("churn") == 0), path)
    io.append_requests(ft.where(F.col("churn") != 0), path)
    return io.read_requests(spark, path)


# -- profiling -----------------------------------------------------------------

def q_row_count(spark, sf_dir):
    return profile.row_count(facts_of(spark, sf_dir))


def q_row_count_clean(spark, sf_dir):
    return profile.row_count(clean_facts(spark, sf_dir))


def q_missing_audit(spark, sf_dir):
    return profile.missing_audit(activity_log(spark, sf_dir))


def q_missing_audit_clean(spark, sf_dir):
    return profile.missing_audit(clean_log(spark, sf_dir))


def q_numeric_describe(spark, sf_dir):
    return profile.numeric_describe(features_of(spark, sf_dir))


def q_activity_describe(spark, sf_dir):
    """Numeric summary of the raw log (epoch-ms ts), in whole milliseconds."""
    return profile.numeric_describe(facts_of(spark, sf_dir), digits=0)


def _edge_rows(spark, sf_dir, n: int, last: bool) -> DataFrame:
    """Rows of the log that can be among the first (last) n by LOG_ORDER, profile joined.

    The n-th ts is looked up in the facts (one row, so broadcast); only rows up
    to it meet the customers.
    """
    facts = event_facts(spark, sf_dir)
    order = F.col("ts").desc_nulls_last() if last else F.col("ts").asc_nulls_first()
    edge = facts.select("ts").orderBy(order).limit(n).agg(
        (F.min("ts") if last else F.max("ts")).alias("edge"), F.count_if(F.col("ts").isNull()).alias("nulls"))
    inside = (F.col("ts") >= F.col("edge")) | (F.col("nulls") > 0) if last else (
        F.col("ts").isNull() | (F.col("ts") <= F.col("edge")))
    return with_users(facts.join(F.broadcast(edge), inside).drop("edge", "nulls"), user_profile(spark, sf_dir))


def q_head_n(spark, sf_dir):
    return profile.head(_edge_rows(spark, sf_dir, HEAD_N, last=False), HEAD_N, LOG_ORDER)


def q_tail_n(spark, sf_dir):
    return profile.tail(_edge_rows(spark, sf_dir, TAIL_N, last=True), TAIL_N, LOG_ORDER)


# -- filters, labels, row forms -------------------------------------------------

def q_drop_blank_users(spark, sf_dir):
    return clean_log(spark, sf_dir)


def q_churn_event_flag(spark, sf_dir):
    return label.churn_event_flag(clean_facts(spark, sf_dir)).select("userId", "page", "ts", "churn")


def q_churn_users(spark, sf_dir):
    return label.churn_users(facts_of(spark, sf_dir))


def q_churn_label_rows(spark, sf_dir):
    return label.churn_label_rows(facts_of(spark, sf_dir)).select("userId", "page", "ts", "churn")


def q_event_date(spark, sf_dir):
    return facts_of(spark, sf_dir).select("userId", "ts", event_date("ts").alias("date"))


def q_state_extract(spark, sf_dir):
    return activity_log(spark, sf_dir).select("userId", "ts", "location", state_of("location").alias("state"))


def _marked(spark, sf_dir):
    ev = rows.with_event_columns(clean_log(spark, sf_dir))
    return rows.mark_last_rows(ev, columns=("level", "state"))


def q_last_level_rows(spark, sf_dir):
    return _marked(spark, sf_dir).select("userId", "ts", "page", "level", "state", "last_level", "last_state")


def q_drop_null_rows(spark, sf_dir):
    """Projection (user, gender, churn, last_level, days_active, last_state) without NULLs, distinct."""
    facts, users = activity_parts(spark, sf_dir)
    return rows.distinct_rows(rows.drop_null_rows(feat.user_rows(facts, users=users)))


def q_distinct_rows(spark, sf_dir):
    """Distinct (userId, level, gender): the facts are made distinct before the profile is joined."""
    facts = event_facts(spark, sf_dir).select("user_id", "userId", "level").distinct()
    users = user_profile(spark, sf_dir)
    return rows.distinct_rows(facts.join(users, facts.user_id == users.c_custkey, "left")
                              .select("userId", "level", "gender"))


# -- windows as aggregates, single features --------------------------------------

def q_user_first_last(spark, sf_dir):
    return feat.user_first_last(facts_of(spark, sf_dir))


def q_songs_per_day(spark, sf_dir):
    return feat.songs_per_day(facts_of(spark, sf_dir))


def q_events_per_day(spark, sf_dir):
    return feat.events_per_day(facts_of(spark, sf_dir))


def q_avg_songs(spark, sf_dir):
    return feat.avg_songs(facts_of(spark, sf_dir))


def q_avg_events(spark, sf_dir):
    return feat.avg_events(facts_of(spark, sf_dir))


def q_thumbs_up(spark, sf_dir):
    return feat.thumbs_up(facts_of(spark, sf_dir))


def q_thumbs_down(spark, sf_dir):
    return feat.thumbs_down(facts_of(spark, sf_dir))


def q_add_friend(spark, sf_dir):
    return feat.add_friend(facts_of(spark, sf_dir))


def q_days_active(spark, sf_dir):
    return feat.user_first_last(facts_of(spark, sf_dir)).select("userId", "days_active")


def _last_profile(spark, sf_dir):
    facts, users = activity_parts(spark, sf_dir)
    return feat.last_profile(facts, users=users)


def q_last_level(spark, sf_dir):
    return _last_profile(spark, sf_dir).select("userId", "last_level")


def q_last_state(spark, sf_dir):
    return _last_profile(spark, sf_dir).select("userId", "last_state")


# -- joins ----------------------------------------------------------------------

def _base_and_days(spark, sf_dir):
    """(one row per user, one row per user and day): the log is scanned once for both."""
    facts, users = activity_parts(spark, sf_dir)
    daily = materialize(feat.daily_activity(facts, with_profile=False))
    return feat.user_base(daily, users=users), daily


def q_join_songs_inner(spark, sf_dir):
    return feat.join_songs_inner(*_base_and_days(spark, sf_dir))


def q_join_events_inner(spark, sf_dir):
    return feat.join_events_inner(*_base_and_days(spark, sf_dir))


def q_join_counts_left(spark, sf_dir):
    return feat.join_counts_left(*_base_and_days(spark, sf_dir))


# -- categories -------------------------------------------------------------------

def q_state_counts(spark, sf_dir):
    return category.category_counts(features_of(spark, sf_dir), "last_state")


def q_top_states(spark, sf_dir):
    return category.top_categories(features_of(spark, sf_dir), "last_state", TOP_K, TOP_SKIP)


def q_collapse_rare_states(spark, sf_dir):
    ft = features_of(spark, sf_dir)
    return category.collapse_rare(ft, "last_state", category.top_categories(ft, "last_state", TOP_K, TOP_SKIP))


# -- encoding (deterministic, SQL-checked) -----------------------------------------

def labelled_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature table with split and fold, checkpointed (lineage cut)."""
    return materialize(encode.labelled(features_of(spark, sf_dir)))


def q_split_assign(spark, sf_dir):
    return encode.split_assign(features_of(spark, sf_dir)).select("userId", "bucket", "split")


def q_fold_assign(spark, sf_dir):
    return encode.fold_assign(features_of(spark, sf_dir)).select("userId", "fold")


def q_string_index(spark, sf_dir):
    data = labelled_of(spark, sf_dir)
    model = encode.indexer("skip").fit(train.train_split(data))
    return model.transform(data).select("userId", *encode.INDEX_OUT)


def q_string_index_strict(spark, sf_dir):
    """The policy that fails on an unseen value, on input that has none (fitted on all users)."""
    data = labelled_of(spark, sf_dir)
    return encode.indexer("error").fit(data).transform(data).select("userId", *encode.INDEX_OUT)


def q_one_hot(spark, sf_dir):
    data = labelled_of(spark, sf_dir)
    prep = encode.fit_preprocess(train.train_split(data), refined=False)
    enc = prep.transform(data)
    parts = [encode.vector_entries(enc, v).select("userId", F.lit(v).alias("vector"), "i", "v")
             for v in encode.VEC_OUT]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_assemble_vector(spark, sf_dir):
    data = labelled_of(spark, sf_dir)
    prep = encode.fit_preprocess(train.train_split(data), refined=False)
    return encode.vector_entries(prep.transform(data), encode.FEATURES)


def q_l1_normalize(spark, sf_dir):
    data = labelled_of(spark, sf_dir)
    prep = encode.fit_preprocess(train.train_split(data), refined=True)
    return encode.vector_entries(prep.transform(data), encode.FEATURES, digits=9)


# -- metrics on a rule prediction (SQL-checked) ----------------------------------------

def rule_predictions(spark, sf_dir):
    """label = churn; prediction = 1 when thumbs down outnumber thumbs up."""
    ft = features_of(spark, sf_dir)
    return ft.select(F.col("churn").cast("double").alias("label"),
                     F.when(F.col("thumbs_down") > F.col("thumbs_up"), 1.0).otherwise(0.0).alias("prediction"))


def q_confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(rule_predictions(spark, sf_dir))


def q_weighted_f1(spark, sf_dir):
    return evaluate.weighted_f1(rule_predictions(spark, sf_dir))


# -- learners, comparison, tuning, scoring (rows-checked) ------------------------------

def _scored(model, data):
    return model.transform(data).select("userId", "split", "label", "prediction")


def q_rf_score(spark, sf_dir):
    data = labelled_of(spark, sf_dir)
    return _scored(train.fit_model(data, "Random Forest", refined=True), data)


def q_lr_score(spark, sf_dir):
    data = labelled_of(spark, sf_dir)
    return _scored(train.fit_model(data, "Logistic Regression", refined=True), data)


def q_gbt_score(spark, sf_dir):
    data = labelled_of(spark, sf_dir)
    return _scored(train.fit_model(data, "Gradient-boosted Tree", refined=True), data)


def q_nb_score(spark, sf_dir):
    """Naive Bayes predictions plus the score margin (raw class-1 minus class-0 log score)."""
    data = labelled_of(spark, sf_dir)
    scored = train.fit_model(data, "Naive Bayes", refined=True).transform(data)
    raw = vector_to_array("rawPrediction")
    return scored.select("userId", "split", "label", "prediction",
                         F.round(raw[1] - raw[0], 6).alias("margin"))


def q_lr_optimality(spark, sf_dir):
    """Gradient of the fitted logistic regression per class and feature, and whether it meets the optimum's conditions."""
    data = train.train_split(labelled_of(spark, sf_dir))
    prep = encode.fit_preprocess(data, refined=True)
    encoded = materialize(prep.transform(data).select("label", encode.FEATURES))
    return optimality.optimality(train.learner("Logistic Regression", True).fit(encoded), encoded)


def _walked(spark, sf_dir, name: str, by_nodes, by_model, value):
    """Per user: do the tables of the fitted trees, walked by joins, say what the model says?"""
    data = labelled_of(spark, sf_dir)
    model = train.fit_model(data, name, refined=True)
    said = materialize(model.transform(data).select("userId", "split", "label", encode.FEATURES, by_model.alias("_said"),
                                                    "prediction"))
    walked = by_nodes(said, trees.node_table(model.stages[-1])).select(
        "userId", value.alias("_walked"), F.col("prediction").alias("_prediction"))
    same = (F.abs(F.col("_said") - F.col("_walked")) <= 1e-9) & (F.col("prediction") == F.col("_prediction"))
    return said.join(walked, "userId", "left").select("userId", "split", "label",
                                                      F.coalesce(same, F.lit(False)).alias("agrees"))


def q_gbt_tree_walk(spark, sf_dir):
    """Boosted trees read as a node table: margin and prediction of every user, held against the model's."""
    return _walked(spark, sf_dir, "Gradient-boosted Tree", trees.boosted_scores,
                   vector_to_array("rawPrediction")[1], F.col("margin"))


def q_rf_tree_walk(spark, sf_dir):
    """The forest read as a node table: class share and prediction of every user, held against the model's."""
    return _walked(spark, sf_dir, "Random Forest", trees.forest_scores, vector_to_array("probability")[1],
                   F.col("probability")[1])


def q_rf_split_audit(spark, sf_dir):
    """Every inner node of the fixed forest (no bootstrap): impurity and gain recomputed from the rows that reach it."""
    data = labelled_of(spark, sf_dir)
    model = train.fit_tuned_forest(data, bootstrap=False)
    rows_ = materialize(model.transform(train.train_split(data)).select("userId", "label", encode.RAW_FEATURES))
    return trees.split_audit(rows_, trees.node_table(model.stages[-1]), train.TUNED["impurity"],
                             features=encode.RAW_FEATURES)


def q_model_predictions(spark, sf_dir):
    """Predictions of all learners on both feature sets in one long table."""
    return train.compare_predictions(labelled_of(spark, sf_dir))


def q_model_compare(spark, sf_dir):
    return train.compare(labelled_of(spark, sf_dir))


_SEARCHES: dict[tuple, tuple[str, DataFrame]] = {}


def _search(data: DataFrame):
    """(best model, scores per fold) of the full grid; one search per application and content of the labelled table.

    The key holds a hash over all rows, so changed data is searched anew.
    """
    spark = data.sparkSession
    content = data.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*data.columns).cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, *content)
    if key not in _SEARCHES:
        scores = train.cv_scores(data)
        best = train.fit_tuned_forest(data, train.best_params(train.cv_table(scores)))
        model_path = scratch_path(spark, "cv-model")
        score.save_model(best, model_path)
        _SEARCHES[key] = model_path, scores
    model_path, scores = _SEARCHES[key]
    return score.load_model(model_path), scores


def q_cv_fold_scores(spark, sf_dir):
    """F1 of every combination on every fold."""
    return _search(labelled_of(spark, sf_dir))[1]


def q_cv_results(spark, sf_dir):
    """Mean F1 over the folds and rank of each of the 54 combinations."""
    return train.cv_table(_search(labelled_of(spark, sf_dir))[1])


def q_tuned_predictions(spark, sf_dir):
    """Predictions of the best cross-validated model for every user."""
    data = labelled_of(spark, sf_dir)
    return _scored(_search(data)[0], data)


def q_tuned_eval(spark, sf_dir):
    """Best cross-validated model scored on train, test and valid: F1 per split."""
    return evaluate.weighted_f1(q_tuned_predictions(spark, sf_dir), keys=("split",))


def q_rf_tuned_score(spark, sf_dir):
    data = labelled_of(spark, sf_dir)
    return _scored(train.fit_tuned_forest(data), data)


def q_nb_f1(spark, sf_dir):
    """Weighted F1 of naive Bayes per split."""
    data = labelled_of(spark, sf_dir)
    return evaluate.weighted_f1(train.fit_model(data, "Naive Bayes", refined=True).transform(data), keys=("split",))


def q_model_save_load(spark, sf_dir):
    """Fitted naive Bayes pipeline saved to the shared folder, loaded back and applied."""
    data = labelled_of(spark, sf_dir)
    path = scratch_path(spark, "model")
    score.save_model(train.fit_model(data, "Naive Bayes", refined=True), path)
    return _scored(score.load_model(path), data)


def _saved_bayes(spark, data):
    path = scratch_path(spark, "model")
    score.save_model(score.fit_scoring_model(data, "Naive Bayes"), path)
    return score.load_model(path)


def _answers(scored):
    return scored.select("userId", F.round(F.col("probability")[1], 9).alias("p_churn"), "prediction", "decision")


def q_batch_score_nb(spark, sf_dir):
    """Every user scored as a request by the saved naive Bayes pipeline, with the churn probability."""
    data = labelled_of(spark, sf_dir)
    return _answers(score.batch_score(_saved_bayes(spark, data), data))


def q_request_score(spark, sf_dir):
    """Form requests: every user's values as the text a form sends, turned into request rows, scored by the saved pipeline."""
    data = labelled_of(spark, sf_dir)
    forms = data.select(*[F.col(c).cast("string").alias(c) for c in FEATURE_COLUMNS if c not in ("churn", "last_level")],
                        F.initcap("last_level").alias("last_level"))
    return _answers(score.batch_score(_saved_bayes(spark, data), io.request_rows(forms)))


def q_batch_score(spark, sf_dir):
    """Every user of the feature table scored as a request by the saved pipeline."""
    data = labelled_of(spark, sf_dir)
    path = scratch_path(spark, "model")
    score.save_model(score.fit_scoring_model(data), path)
    requests = data.select(*[c for c in FEATURE_COLUMNS if c != "churn"])  # same checkpointed feature rows
    return score.batch_score(score.load_model(path), requests)


def queries() -> dict[str, Query]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
