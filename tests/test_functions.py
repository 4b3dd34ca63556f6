import datetime as dt

import pytest
from pyspark.sql import functions as F

from retentia.functions.columns import event_date, hash_bucket, state_of


@pytest.mark.parametrize("loc,state", [
    ("Boston-Cambridge-Newton, MA-NH", "NH"),
    ("Dallas, TX", "TX"),
    ("Metro-NATION_0, ZZ-AX", "AX"),
    ("New York-Newark, NY-NJ-PA", "PA"),
    ("Nowhere", "Nowhere"),
    ("A,\tCA \n", "CA"),
    ("A, B-\tWY\t", "WY"),
    (None, None),
])
def test_state_of(spark, loc, state):
    df = spark.createDataFrame([(loc,)], "location string")
    assert df.select(state_of("location").alias("s")).first()["s"] == state


def test_event_date_utc_whatever_the_session_zone(spark):
    ts = [1538438399999, 1538438400000, 0, -1]
    want = [dt.date(2018, 10, 1), dt.date(2018, 10, 2), dt.date(1970, 1, 1), dt.date(1969, 12, 31)]
    df = spark.createDataFrame([(t,) for t in ts], "ts bigint")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r["d"] for r in df.select(event_date("ts").alias("d")).collect()]
            assert got == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_hash_bucket_matches_md5_rule(spark):
    import hashlib
    keys = ["42", "1", "100001", "abc"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r["b"] for r in df.select(hash_bucket("k", 10).alias("b")).collect()]
    want = [int(hashlib.md5(k.encode()).hexdigest()[:8], 16) % 10 for k in keys]
    assert got == want


def test_no_python_udf_in_feature_plan(spark, unit_log):
    from retentia.operators.features import feature_table
    plan = feature_table(unit_log)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_activity_ts_is_zone_independent(spark):
    from retentia.sources.activity import event_facts
    old = spark.conf.get("spark.sql.session.timeZone")
    sums = []
    try:
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            fresh = event_facts(spark, "/root/testdata/sf0.001")  # analysed under this zone
            sums.append(fresh.agg(F.sum("ts")).first()[0])
        lit = spark.sql("select timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                        "TIMESTAMP_NTZ'2024-07-01 12:00:00.123456') a").first()["a"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert sums[0] == sums[1]
    assert lit == 1719835200123
