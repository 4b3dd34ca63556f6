from pyspark.sql import functions as F

from retentia.operators import features as feat
from retentia.plans import catalog
from retentia.schema import FEATURE_COLUMNS, FEATURES
from retentia.sources.activity import activity_log, activity_parts
from tests.conftest import SF_SMALL, UNIT_EXPECTED, rows_of


def test_unit_feature_table(unit_log):
    out = feat.feature_table(unit_log)
    assert out.columns == FEATURE_COLUMNS
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in FEATURES.fields]
    assert rows_of(out) == sorted(UNIT_EXPECTED)


def test_unit_join_form_agrees(unit_log):
    assert rows_of(feat.feature_table_joinform(unit_log)) == sorted(UNIT_EXPECTED)


def test_tie_at_last_ts_gives_one_row_greatest_level(unit_log):
    out = feat.feature_table(unit_log).where("userId = '5'").collect()
    assert len(out) == 1 and out[0]["last_level"] == "paid"


def test_user_without_songs_and_null_state_dropped(unit_log):
    ids = {r.userId for r in feat.feature_table(unit_log).collect()}
    assert "3" not in ids  # no NextSong at all
    assert "4" not in ids  # last row has no state
    assert "" not in ids and None not in ids


def test_incomplete_tie_row_does_not_hide_complete_one(spark):
    from retentia.schema import EVENT
    log = spark.createDataFrame([
        ("9", "NextSong", 1000, None, "F", "X, CA"),
        ("9", "NextSong", 1000, "free", "F", "X, CA"),
    ], EVENT)
    out = feat.feature_table(log).collect()
    assert len(out) == 1 and out[0]["last_level"] == "free"


def test_round_half_up_like_spark(spark):
    # 199 days with 1 song and one with 2: mean 1.005 -> 1.01 (half up).
    daily = spark.createDataFrame(
        [("u", i, 1 if i else 2) for i in range(200)], "userId string, d int, n_songs bigint")
    daily = daily.select(
        "userId", F.date_from_unix_date("d").alias("date"), F.col("n_songs").alias("n_events"), "n_songs",
        F.lit(0).cast("bigint").alias("n_up"), F.lit(0).cast("bigint").alias("n_down"),
        F.lit(0).cast("bigint").alias("n_friend"), F.lit(0).alias("churn"),
        F.struct(F.lit(1).alias("ts"), F.lit("free").alias("level")).alias("last"))
    r = feat.user_activity(daily).first()
    assert r["avg_songs"] == 1.01 and r["avg_events"] == 1.01


def test_dimension_form_equals_row_form(spark):
    facts, users = activity_parts(spark, SF_SMALL)
    a = rows_of(feat.feature_table(facts, users=users))
    b = rows_of(feat.feature_table(activity_log(spark, SF_SMALL)))
    c = rows_of(feat.feature_table_joinform(activity_log(spark, SF_SMALL)))
    d = rows_of(feat.feature_table_joinform(facts, users=users))
    assert a == b == c == d and len(a) > 0


def test_invariant_to_row_order_and_partitioning(spark):
    log = activity_log(spark, SF_SMALL).cache()
    base = rows_of(feat.feature_table(log))
    for n in (1, 7, 32):
        shuffled = log.repartition(n).orderBy(F.rand(n))
        assert rows_of(feat.feature_table(shuffled)) == base
    log.unpersist()


def test_hot_user_with_a_third_of_rows(spark):
    # One user holds a third of all rows: result equals the join form.
    log = activity_log(spark, SF_SMALL)
    n = log.count()
    hot = log.where("userId <> ''").limit(n // 2).withColumn("userId", F.lit("777"))
    skewed = log.unionByName(hot)
    assert rows_of(feat.feature_table(skewed)) == rows_of(feat.feature_table_joinform(skewed))


def test_single_features_match_table(spark):
    log = activity_log(spark, SF_SMALL)
    ft = feat.feature_table(log)
    songs = feat.avg_songs(log)
    j = ft.join(songs.withColumnRenamed("avg_songs", "s"), "userId")
    assert j.where("avg_songs <> s").count() == 0
    assert j.count() == ft.count()


def test_entry_runs(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.columns == FEATURE_COLUMNS
    assert df.count() > 0


def test_every_query_has_unique_name_and_sql_keys_subset():
    import __spark_entry__ as se
    assert set(se.oracle_sql()) <= set(se.queries())
    assert "feature_table" in se.queries()


def test_catalog_flagship_is_feature_table(spark):
    df = catalog.q_feature_table(spark, SF_SMALL)
    assert df.columns == FEATURE_COLUMNS
