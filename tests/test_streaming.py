from retentia.operators.features import feature_table
from retentia.schema import EVENT
from retentia.session import scratch_path
from retentia.streaming import features_from_partials, start_partials_stream
from tests.conftest import T, UNIT_ROWS, rows_of


def test_stream_equals_batch_and_is_incremental(spark, unit_log):
    source = scratch_path(spark, "t-stream-src")
    sink, ckpt = scratch_path(spark, "t-stream-sink"), scratch_path(spark, "t-stream-ckpt")
    unit_log.repartition(3).write.parquet(source)
    q = start_partials_stream(spark, source, sink, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    assert rows_of(features_from_partials(spark, sink)) == rows_of(feature_table(unit_log))
    first_batches = {r.batch_id for r in spark.read.parquet(sink).select("batch_id").distinct().collect()}
    assert len(first_batches) == 3

    # New file: user 2 cancels two days later.  Restart from the same checkpoint.
    more = [("2", "Cancellation Confirmation", T + 2 * 86400000, "free", "M", "Dallas, TX")]
    spark.createDataFrame(more, EVENT).write.mode("append").parquet(source)
    q = start_partials_stream(spark, source, sink, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    batches = {r.batch_id for r in spark.read.parquet(sink).select("batch_id").distinct().collect()}
    assert len(batches) == 4  # only the new file was processed
    whole = spark.createDataFrame(UNIT_ROWS + more, EVENT)
    got = rows_of(features_from_partials(spark, sink))
    assert got == rows_of(feature_table(whole))
    assert [r for r in got if r[0] == "2"][0][2] == 1  # churned now


def test_replayed_and_unfinished_batches(spark, unit_log):
    """A complete batch is left alone by a replay; an unfinished one is not read and is rewritten."""
    import os

    from retentia.streaming.daily import read_partials
    source, sink = scratch_path(spark, "t-replay-src"), scratch_path(spark, "t-replay-sink")
    unit_log.repartition(2).write.parquet(source)
    run = lambda: start_partials_stream(
        spark, source, sink, scratch_path(spark, "t-replay-ckpt"), max_files_per_trigger=1).awaitTermination()
    run()
    want = rows_of(feature_table(unit_log))
    files = sorted(os.listdir(f"{sink}/batch_id=0"))
    run()                                        # a new checkpoint: every batch is replayed
    assert sorted(os.listdir(f"{sink}/batch_id=0")) == files
    assert rows_of(features_from_partials(spark, sink)) == want
    os.rename(f"{sink}/batch_id=1/_SUCCESS", f"{sink}/batch_id=1/unfinished")
    part = read_partials(spark, sink).count()
    run()
    assert part < read_partials(spark, sink).count()
    assert rows_of(features_from_partials(spark, sink)) == want
