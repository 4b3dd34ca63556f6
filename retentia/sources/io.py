"""Readers and writers with declared schemas (no inference pass)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.schema import EVENT, FEATURE_COLUMNS, FEATURES


def read_events(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = EVENT) -> DataFrame:
    """Event log in JSON lines, parquet or headered CSV, read with the declared schema."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def write_events(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(fmt).save(path)


def write_features(df: DataFrame, path: str, fmt: str = "csv", header: bool = False,
                   mode: str = "errorifexists") -> None:
    """Feature table sink.  CSV keeps the positional column order of FEATURES."""
    out = df.select(*FEATURE_COLUMNS).write.mode(mode)
    if fmt == "csv":
        out.option("header", header).csv(path)
    else:
        out.format(fmt).save(path)


def read_features(spark: SparkSession, path: str, fmt: str = "csv", header: bool = False) -> DataFrame:
    """Feature table source over a whole directory of part files, typed by FEATURES."""
    reader = spark.read.schema(FEATURES)
    if fmt == "csv":
        # The header, if any, is skipped; columns are bound by position to FEATURES.
        return reader.option("header", header).option("enforceSchema", True).csv(path)
    return reader.format(fmt).load(path)


def append_requests(df: DataFrame, path: str) -> None:
    """Append a batch of scoring requests to a parquet request log."""
    df.select(*FEATURE_COLUMNS).write.mode("append").parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).parquet(path)


def request_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Scoring requests given as values (one dict per row, feature names as keys).

    ``churn`` is optional; level is lower-cased to match the training data.
    """
    cols = [c for c in FEATURE_COLUMNS]
    data = [tuple(r.get(c) for c in cols) for r in rows]
    df = spark.createDataFrame(data, FEATURES)
    return df.withColumn("last_level", F.lower("last_level"))


def request_rows(table: DataFrame) -> DataFrame:
    """Scoring requests in any table, as rows of the request schema.

    Columns are matched by name in any case; one that is missing is NULL, others
    are dropped.  Values typed as text are cast, and one that is no number is
    NULL, so that the scorer leaves that row without an answer; level is
    lower-cased to match the training data.
    """
    given = {c.lower(): c for c in table.columns}
    rows = table.select(*[
        (F.col(f"`{given[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in given else F.lit(None).cast(f.dataType))
        .alias(f.name) for f in FEATURES.fields])
    return rows.withColumn("last_level", F.lower("last_level"))
