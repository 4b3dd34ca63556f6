"""Profiling: missing-value audit, counts, numeric summary, head and tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import missing_test

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def missing_audit(df: DataFrame) -> DataFrame:
    """One wide row: per column, the number of "missing" values (one pass)."""
    return df.agg(*[F.count_if(missing_test(f.name, f.dataType)).alias(f.name) for f in df.schema.fields])


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def numeric_describe(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Long form (column, count, mean, stddev, min, max) of the numeric columns.

    One aggregation pass over the data computes every statistic of every
    column; the single result row is then unpivoted with ``stack``.  Integral
    means are taken over exact decimals.
    """
    cols = columns or numeric_columns(df)
    aggs = []
    for c in cols:
        dtype = df.schema[c].dataType
        exact = F.col(c).cast("decimal(38,0)") if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType,
                                                                     T.LongType)) else F.col(c)
        aggs += [F.count(c).alias(f"{c}__n"),
                 F.avg(exact).cast("double").alias(f"{c}__mean"),
                 F.stddev_samp(c).cast("double").alias(f"{c}__sd"),
                 F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max")]
    wide = df.agg(*aggs)
    args = ", ".join(f"'{c}', `{c}__n`, `{c}__mean`, `{c}__sd`, `{c}__min`, `{c}__max`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {args}) AS (column, count, mean, stddev, min, max)")
    return long.select("column", "count", *[F.round(c, digits).alias(c) for c in ("mean", "stddev", "min", "max")])


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows in a stated order (ascending, NULLs first): a top-n, no full sort."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Last n rows of the same order, i.e. the first n of the reversed order."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)
