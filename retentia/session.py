"""Session construction and the shared scratch location.

Scratch output (sink round trips, saved models, lineage cuts) always goes below
the directory the cluster names in ``spark.checkpoint.dir``: a shared file
system on a cluster.  A local default is set only when the setting is absent,
which is the case in unit tests only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings that matter at scale: AQE re-plans joins and partition counts from
# runtime sizes, splits skewed join partitions and coalesces small shuffles.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = "local[8]", shuffle_partitions: int | None = 8,
                  app_name: str = "retentia", extra: dict | None = None) -> SparkSession:
    """Session with the engine's settings.

    ``master=None`` / ``shuffle_partitions=None`` leave those to spark-submit
    (cluster runs); tests and the bench pass local values.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint root; a local one is set only if none is set and the master is local."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="retentia-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused directory below the shared checkpoint root."""
    run = spark.sparkContext.applicationId
    return f"{ensure_checkpoint_dir(spark)}/retentia-scratch/{run}/{name}-{uuid.uuid4().hex}"


def materialize(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint below ``spark.checkpoint.dir``.

    Used before iterative work (learners, cross-validation) so that every pass
    re-reads the small checkpointed table instead of re-running the scan of
    the event log, and a lost executor recomputes from the checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df, name: str):
    """``df`` written as Parquet to a fresh scratch path and read back: later readers share one result."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
