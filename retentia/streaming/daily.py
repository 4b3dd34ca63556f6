"""Feature table maintained incrementally from a stream of event-log files.

Each micro-batch is reduced to stage-1 partials (one row per user, day and
profile values; see ``operators.features.value_partials``) and written under
``<sink>/batch_id=<id>``.  A batch is complete when its writer has left the
``_SUCCESS`` file.  A replay after a failure finds a complete batch and leaves
it alone, or rewrites an incomplete one, which no reader has seen; with the
stream checkpoint the sink is exactly-once.  The raw rows are aggregated once,
when they arrive; the per-user table is derived on demand from the compact
partials, whose columns (counts, max flag, max ts) combine across batches.

No watermark is needed: nothing is kept in streaming state, late events of
an old day simply add a partial row for that day, and the per-day stage
merges them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from retentia.operators.features import days_from_partials, features_from_days, value_partials
from retentia.schema import DEFAULT_SPEC, EVENT, FeatureSpec


def start_partials_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, fmt: str = "parquet",
                          spec: FeatureSpec = DEFAULT_SPEC, with_profile: bool = True,
                          max_files_per_trigger: int | None = None, interval: str | None = None,
                          schema=EVENT) -> StreamingQuery:
    """Start the stream: files under ``source`` -> stage-1 partials under ``sink``.

    ``interval`` (as "5 minutes") keeps the stream running; without it the
    files that are there are worked off and the stream ends.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.load(source)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        path = f"{sink}/batch_id={batch_id}"
        if not _paths(spark, f"{path}/_SUCCESS"):
            value_partials(batch, spec, with_profile).write.mode("overwrite").parquet(path)

    writer = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def read_partials(spark: SparkSession, sink: str, spec: FeatureSpec = DEFAULT_SPEC, with_profile: bool = True,
                  schema=EVENT) -> DataFrame:
    """The partials of all complete batches, with the schema that ``value_partials`` gives."""
    kind = value_partials(spark.createDataFrame([], schema), spec, with_profile).schema
    done = [p.removesuffix("/_SUCCESS") for p in _paths(spark, f"{sink}/batch_id=*/_SUCCESS")]
    return spark.read.schema(kind).parquet(*done) if done else spark.createDataFrame([], kind)


def features_from_partials(spark: SparkSession, sink: str, spec: FeatureSpec = DEFAULT_SPEC,
                           users: DataFrame | None = None) -> DataFrame:
    """Feature table from all batches completed so far (same result as the batch job)."""
    partials = read_partials(spark, sink, spec, with_profile=users is None)
    return features_from_days(days_from_partials(partials), spec, users)
