"""Scalar column expressions used by the operators.

Every function returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage code generation and is pushed through the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MS_PER_DAY = 86_400_000
# The characters Python's str.strip() removes by default
# (space, tab, newline, carriage return, vertical tab, form feed).
WHITESPACE = " \t\n\r\x0b\x0c"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_date(ts_ms) -> Column:
    """Epoch milliseconds -> UTC calendar DATE, independent of the session zone."""
    return F.date_from_unix_date(F.floor(_col(ts_ms) / F.lit(MS_PER_DAY)).cast("int"))


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def state_of(location) -> Column:
    """State code of a ``"City-City, ST-ST"`` location.

    Last comma-separated part, trimmed; when that is longer than two
    characters, its last dash-separated part, trimmed.  NULL stays NULL.
    """
    tail = strip(F.element_at(F.split(_col(location), ",", -1), -1))
    return F.when(F.length(tail) > 2, strip(F.element_at(F.split(tail, "-", -1), -1))).otherwise(tail)


def flag_page(page, name: str) -> Column:
    """1 where the page equals ``name`` else 0 (a NULL page gives 0)."""
    return F.when(_col(page) == F.lit(name), F.lit(1)).otherwise(F.lit(0)).cast("int")


def hash_bucket(key, buckets: int = 10) -> Column:
    """Deterministic bucket 0..buckets-1 from the md5 of the key's text.

    First 8 hex digits of md5 read as an unsigned 32-bit number, modulo
    ``buckets``; the same number DuckDB gets from ``('0x'||substr(md5(k),1,8))::BIGINT``.
    """
    h = F.conv(F.substring(F.md5(_col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(buckets)).cast("int")


def missing_test(name: str, dtype: T.DataType) -> Column:
    """Type-aware "missing" predicate of the profiling audit.

    Text columns: contains 'None' or 'NULL' (substring), equals '', or NULL.
    Floating columns: NULL or NaN.  Any other type: NULL only.
    (Applying the text tests to numbers, or NaN to text, raises under ANSI mode.)
    """
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return c.contains("None") | c.contains("NULL") | (c == F.lit("")) | c.isNull()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()
