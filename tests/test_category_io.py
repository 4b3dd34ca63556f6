from retentia.operators import category
from retentia.plans.catalog import features_of
from retentia.schema import FEATURE_COLUMNS
from retentia.session import scratch_path
from retentia.sources import io
from tests.conftest import SF_SMALL, rows_of

# Counts of the shipped sample's states at the top of the list.
STATE_COUNTS = [("CA", 33), ("PA", 18), ("TX", 16), ("FL", 14), ("WI", 10), ("IL", 9), ("NC", 9),
                ("SC", 8), ("AZ", 7), ("CT", 7), ("MD", 7), ("NH", 7), ("VT", 1)]


def _states(spark):
    rows = [(s,) for s, n in STATE_COUNTS for _ in range(n)]
    return spark.createDataFrame(rows, "last_state string")


def test_top_skips_leader_and_breaks_ties_by_value(spark):
    top = category.top_categories(_states(spark), "last_state", 10, 1).orderBy("rank").collect()
    assert [r.last_state for r in top] == ["PA", "TX", "FL", "WI", "IL", "NC", "SC", "AZ", "CT", "MD"]
    assert [r["rank"] for r in top] == list(range(2, 12))


def test_collapse_sends_leader_and_rare_to_other(spark):
    df = _states(spark)
    out = category.collapse_rare(df, "last_state", category.top_categories(df, "last_state"))
    counts = dict(rows_of(out.groupBy("last_state").count()))
    assert counts["OTHER"] == 33 + 7 + 1
    assert "CA" not in counts and "NH" not in counts


def test_collapse_stage_matches_join_and_persists(spark, tmp_path):
    from pyspark.ml.feature import SQLTransformer
    df = _states(spark)
    stage = category.collapse_stage(df, "last_state")
    p = str(tmp_path / "stage")
    stage.save(p)
    loaded = SQLTransformer.load(p)
    a = rows_of(loaded.transform(df))
    b = rows_of(category.collapse_rare(df, "last_state", category.top_categories(df, "last_state")))
    assert a == b


def test_collapse_stage_matches_join_on_odd_strings(spark):
    odd = ["a\\b", "it's", "x\\'y", "tab\t", "q\"q", "`t`", "\\", "%_"]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(odd) for _ in range(i + 2)], "`last``state` string, n int")
    top = category.top_categories(df.withColumnRenamed("last`state", "s"), "s", 10, 1).withColumnRenamed("s", "last`state")
    want = rows_of(category.collapse_rare(df.withColumnRenamed("last`state", "s"),
                                          "s", top.withColumnRenamed("last`state", "s"), other="o\\'"))
    stage = category.collapse_stage(df.withColumnRenamed("last`state", "s"), "s", other="o\\'")
    assert rows_of(stage.transform(df.withColumnRenamed("last`state", "s")), ["s", "n"]) == sorted(
        want, key=lambda t: tuple((1, str(x)) for x in t))
    assert ("a\\b", 0) in want


def test_json_events_with_declared_schema(spark, unit_log):
    p = scratch_path(spark, "t-json")
    io.write_events(unit_log, p, fmt="json")
    back = io.read_events(spark, p, fmt="json")
    assert rows_of(back) == rows_of(unit_log)
    assert back.schema == unit_log.schema


def test_headerless_csv_roundtrip_reads_all_parts(spark):
    ft = features_of(spark, SF_SMALL)
    p = scratch_path(spark, "t-csv")
    io.write_features(ft.repartition(5), p)
    back = io.read_features(spark, p)
    assert back.columns == FEATURE_COLUMNS
    assert rows_of(back) == rows_of(ft)


def test_header_csv_and_append_log(spark):
    ft = features_of(spark, SF_SMALL)
    p = scratch_path(spark, "t-csvh")
    io.write_features(ft, p, header=True)
    assert rows_of(io.read_features(spark, p, header=True)) == rows_of(ft)
    r = scratch_path(spark, "t-req")
    io.append_requests(ft.where("churn = 0"), r)
    io.append_requests(ft.where("churn = 1"), r)
    assert rows_of(io.read_requests(spark, r)) == rows_of(ft)


def test_request_frame_level_lowercased_label_optional(spark):
    df = io.request_frame(spark, [{"userId": "7", "gender": "M", "last_level": "Paid", "days_active": 3,
                                   "last_state": "TX", "avg_songs": 1.0, "avg_events": 2.0, "thumbs_up": 1,
                                   "thumbs_down": 0, "addfriend": 0}])
    r = df.first()
    assert r.last_level == "paid" and r.churn is None
