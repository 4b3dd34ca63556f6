"""Row-level cleaning and derived columns of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import event_date, flag_page, state_of
from retentia.operators.skew import salted_join
from retentia.schema import DEFAULT_SPEC, FeatureSpec


def drop_blank_users(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """Keep rows with a user.  ``user != ''`` is NULL for a NULL user, so those go too."""
    return events.where(F.col(spec.user) != F.lit(""))


def with_event_columns(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """Add ``date`` (UTC day of ts), ``state`` (of location) and ``churn`` (cancel flag)."""
    cols = {"date": event_date(spec.ts), "churn": flag_page(spec.page, spec.cancel_page)}
    if spec.location in events.columns:
        cols["state"] = state_of(spec.location)
    return events.withColumns(cols)


def user_extremes(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per user: first/last ts (hash aggregate with map-side combine)."""
    return events.groupBy(spec.user).agg(
        F.min(spec.ts).alias("first_ts"), F.max(spec.ts).alias("last_ts"))


def mark_last_rows(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC,
                   columns: tuple[str, ...] = ("level",)) -> DataFrame:
    """Row form of "value on the user's last event, NULL elsewhere".

    Every row keeps its columns and gets ``last_<c>`` for each named column.
    The per-user last ts is joined back on (user, ts), each such key salted by
    the row's columns and the partition it was read in: a user with a large
    share of all rows is spread over many tasks, also if a bulk import stamped
    all of them with one ts or they are equal in every column.
    """
    lasts = user_extremes(events, spec).select(F.col(spec.user).alias("_u"), F.col("last_ts").alias("_t"),
                                               F.lit(True).alias("_is_last"))
    rows = events.withColumns({"_u": F.col(spec.user), "_t": F.col(spec.ts)})
    j = salted_join(rows, lasts, ["_u", "_t"], (F.spark_partition_id(), *events.columns), "left")
    hit = F.coalesce(F.col("_is_last"), F.lit(False))
    return j.select(*events.columns, *[F.when(hit, F.col(c)).alias(f"last_{c}") for c in columns])


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any (or any listed) column."""
    return df.na.drop(how="any", subset=subset)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()
