"""Tables written below the shared folder and read back: a lineage cut that survives lost executors."""

from __future__ import annotations

import contextlib
import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.session import scratch_path


#: Spark then deletes the shuffle files of a query when it ends, else when the driver has collected its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _brief_shuffles(spark: SparkSession):
    """Queries run here leave no shuffle files behind; the session's own setting comes back afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and return the written table."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    with _brief_shuffles(spark):                     # readers read the table, never the exchanges that led to it
        df.write.option("compression", "zstd").parquet(path)
    _made().append(path)
    return spark.read.schema(schema).parquet(path)


_LOCAL = threading.local()


def _made() -> list[str]:
    """Paths of the tables stored by this thread and not released yet."""
    if not hasattr(_LOCAL, "made"):
        _LOCAL.made = []
    return _LOCAL.made


def tidy(function):
    """An operator whose stored tables are deleted when it returns, but for those that its result still reads."""
    @functools.wraps(function)
    def run(*args, **kwargs):
        mark = len(_made())
        out = function(*args, **kwargs)
        needed = [f for df in (out if isinstance(out, tuple) else (out,)) if isinstance(df, DataFrame)
                  for f in df.inputFiles()]
        kept = []
        for path in _made()[mark:]:
            name = path.rsplit("/", 1)[-1]           # unique: it ends with a random id
            if any(f"/{name}/" in f for f in needed):
                kept.append(path)
            else:
                spark = SparkSession.active()
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _made()[mark:] = kept
        return out

    return run


def shuffle_width(spark) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``table`` (one row per key) on ``key``, each key spread over SALTS tasks.

    The salt of a row is a hash of its ``spread`` columns, so a key that a
    third of all rows share is split, and a task that runs again salts alike.
    """
    many = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return salted.join(many, [key, "_salt"], how).drop("_salt")
