import math

from pyspark.sql import functions as F

from retentia.operators import label, profile, rows
from retentia.schema import EVENT
from tests.conftest import rows_of


def test_missing_audit_is_type_aware(spark, unit_log):
    r = profile.missing_audit(unit_log).first().asDict()
    assert r == {"userId": 2, "page": 0, "ts": 0, "level": 0, "gender": 2, "location": 3}


def test_missing_audit_substrings_and_nan(spark):
    df = spark.createDataFrame([("a None b", 1.0, 1), ("NULL", float("nan"), None), ("x", None, 2)],
                               "s string, d double, i bigint")
    r = profile.missing_audit(df).first().asDict()
    assert r == {"s": 2, "d": 2, "i": 1}


def test_row_counts(unit_log):
    assert profile.row_count(unit_log).first()["n_rows"] == 13
    assert profile.row_count(rows.drop_blank_users(unit_log)).first()["n_rows"] == 11


def test_numeric_describe(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 4.0), (5, None)], "a int, b double")
    out = {r["column"]: r for r in profile.numeric_describe(df).collect()}
    assert out["a"]["count"] == 3 and out["a"]["mean"] == 3.0 and out["a"]["stddev"] == 2.0
    assert out["b"]["count"] == 2 and out["b"]["min"] == 2.0 and out["b"]["max"] == 4.0
    assert math.isclose(out["b"]["stddev"], 1.4142, abs_tol=1e-9)


def test_head_tail(unit_log):
    h = profile.head(unit_log, 2, ["ts", "userId", "page"]).collect()
    assert [r.userId for r in h] == [None, ""]
    t = profile.tail(unit_log, 1, ["ts", "userId", "page"]).collect()
    assert t[0].page == "Cancellation Confirmation"


def test_blank_filter_drops_null_too(unit_log):
    ids = {r.userId for r in rows.drop_blank_users(unit_log).collect()}
    assert "" not in ids and None not in ids


def test_churn_flags_and_spread(unit_log):
    flags = label.churn_event_flag(unit_log).where("churn = 1").collect()
    assert len(flags) == 1
    users = dict(rows_of(label.churn_users(unit_log)))
    assert users == {"1": 1, "2": 0, "3": 0, "4": 0, "5": 0}
    spread = label.churn_label_rows(unit_log)
    assert spread.where("userId = '1' AND churn = 1").count() == 5
    assert spread.count() == 11


def test_null_page_is_not_churn(spark):
    df = spark.createDataFrame([("1", None, 1, "free", "F", "a, CA")], EVENT)
    assert label.churn_event_flag(df).first()["churn"] == 0


def test_mark_last_rows(unit_log):
    ev = rows.with_event_columns(rows.drop_blank_users(unit_log))
    m = rows.mark_last_rows(ev, columns=("level", "state"))
    assert m.count() == 11
    last1 = m.where("userId = '1' AND last_level IS NOT NULL").collect()
    assert len(last1) == 1 and last1[0].last_state == "NH"
    assert m.where("userId = '5' AND last_level IS NOT NULL").count() == 2  # tie: both rows are last


def test_user_extremes(unit_log):
    from retentia.operators.features import user_first_last
    r = {x.userId: x for x in user_first_last(unit_log).collect()}
    assert r["1"].days_active == 3 and r["2"].days_active == 0


def _with_hot_user(spark):
    from retentia.sources.activity import activity_log
    log = activity_log(spark, "/root/testdata/sf0.001")
    hot = log.where("userId <> ''").withColumn("userId", F.lit("777"))
    return log.unionByName(hot).unionByName(hot)


def test_salted_label_spread_equals_plain_join(spark):
    skewed = _with_hot_user(spark)
    plain = rows.drop_blank_users(skewed).join(label.churn_users(skewed), "userId")
    assert rows_of(label.churn_label_rows(skewed)) == rows_of(plain)


def test_salted_label_spread_spreads_hot_user(spark):
    out = label.churn_label_rows(_with_hot_user(spark))
    # As at scale: per-user side too big to broadcast, no coalescing of tiny partitions.
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        parts = out.where("userId = '777'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert parts > 1


def test_salt_needs_only_the_spread_columns(spark):
    out = label.churn_label_rows(_with_hot_user(spark)).select("userId", "page", "ts", "churn")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "location" not in plan and "gender" not in plan
