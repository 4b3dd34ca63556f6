"""Physical-plan properties that matter at scale."""

import re

import pytest

from retentia.plans import catalog
from tests.conftest import SF_MID, SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_columns_and_hashes_raw_rows(spark):
    plan = _plan(catalog.q_feature_table(spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", catalog.q_feature_table(spark, SF_SMALL)
                         ._jdf.queryExecution().explainString(
                             spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    events_schema = [s for s in schemas if "event_type" in s][0]
    assert "props" not in events_schema
    # The aggregate directly above the event scan is a hash aggregate (no sort of raw rows).
    lines = plan.splitlines()
    scan = max(i for i, ln in enumerate(lines) if "events.parquet" in ln or "FileScan parquet" in ln
               and "event_type" in ln)
    above = [ln for ln in lines[:scan] if "Aggregate" in ln]
    assert above and "HashAggregate" in above[-1]
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # No cartesian product or nested-loop join anywhere.
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_last_row_join_is_keyed_by_user_ts_and_salt(spark):
    plan = _plan(catalog.q_last_level_rows(spark, SF_SMALL))
    joins = [ln for ln in plan.splitlines() if "Join" in ln and "_u#" in ln]
    assert joins and all(re.search(r"\[_u#\d+, _t#\d+L?, _salt#\d+\]", ln) for ln in joins)    # salted: hot (user, ts) pairs are split


def test_top_k_is_bounded(spark):
    plan = _plan(catalog.q_top_states(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_metrics_do_not_use_python(spark):
    plan = _plan(catalog.q_weighted_f1(spark, SF_SMALL))
    assert "Python" not in plan


def test_aqe_splits_hot_key_in_scan_to_scan_join(spark):
    from pyspark.sql import functions as F
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
        skewed = ev.unionByName(ev.withColumn("user_id", F.lit(7).cast("bigint")))
        cust = spark.read.parquet("/root/testdata/sf0.01/customer.parquet")
        out = skewed.join(cust, skewed.user_id == cust.c_custkey, "left")
        out.collect()
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# Queries that need no profile: with the customer table too big to broadcast
# they neither scan it nor shuffle more than their aggregates need.
FACTS_ONLY = {"row_count": 1, "row_count_clean": 1, "activity_describe": 1, "churn_event_flag": 0, "churn_users": 1,
              "event_date": 0, "songs_per_day": 1, "events_per_day": 1, "avg_songs": 2, "avg_events": 2, "thumbs_up": 1,
              "thumbs_down": 1, "add_friend": 1, "user_first_last": 1, "days_active": 1, "churn_label_rows": 3}


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(FACTS_ONLY))
def test_facts_only_plans(spark, no_broadcast, name):
    plan = _plan(catalog.queries()[name](spark, SF_SMALL))
    assert "customer" not in plan and "c_custkey" not in plan
    assert len(re.findall(r"\bExchange ", plan)) <= FACTS_ONLY[name]


@pytest.mark.parametrize("name", ["join_songs_inner", "join_events_inner", "join_counts_left", "feature_table_joinform",
                                  "last_level", "last_state"])
def test_log_is_scanned_once_at_most(spark, no_broadcast, name):
    """The join forms read the (user, day) table that one scan of the log has written."""
    plan = _plan(catalog.queries()[name](spark, SF_SMALL))
    assert len(re.findall(r"FileScan parquet \[[^\]]*event_type", plan)) <= 1


def test_head_joins_only_the_first_rows(spark, no_broadcast):
    df = catalog.q_head_n(spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    outer = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x)
    assert any("edge" in x for x in lines[outer:])


def test_adapter_branches_are_reached(spark):
    """The mapped log has users without songs, zero counts and ties at the last ts."""
    users = catalog.q_churn_users(spark, SF_MID).count()
    table = catalog.q_feature_table(spark, SF_MID)
    assert table.count() < users
    assert all(table.where(f"{c} = 0").count() > 0 for c in ("thumbs_up", "thumbs_down", "addfriend"))
    assert catalog.q_drop_null_rows(spark, SF_MID).count() > users


def test_adapter_reads_files_added_later(spark, tmp_path):
    from retentia.sources.activity import event_facts
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(100)
    ev.write.parquet(str(tmp_path / "events.parquet"))
    assert event_facts(spark, str(tmp_path)).count() == 100
    ev.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert event_facts(spark, str(tmp_path)).count() == 200


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from retentia.session import CHECKPOINT_CONF, ensure_checkpoint_dir

    class Conf(dict):
        set = dict.__setitem__

    class Context:
        master, folder = "spark://host:7077", None

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match=CHECKPOINT_CONF):
        ensure_checkpoint_dir(Session())
    Session.conf[CHECKPOINT_CONF] = "hdfs://shared/checkpoints"
    assert ensure_checkpoint_dir(Session()) == "hdfs://shared/checkpoints"
    Session.conf, Session.sparkContext = Conf(), Context()
    Session.sparkContext.master = "local[2]"
    assert ensure_checkpoint_dir(Session())
