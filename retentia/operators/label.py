"""Churn label: event flag and its spread to every row of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import flag_page
from retentia.operators.rows import drop_blank_users
from retentia.operators.skew import SALTS, salted_join
from retentia.schema import DEFAULT_SPEC, FeatureSpec


def churn_event_flag(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """Row form: ``churn`` = 1 on cancellation rows, else 0."""
    return events.withColumn("churn", flag_page(spec.page, spec.cancel_page))


def churn_users(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """User form: one row per user, ``churn`` = 1 if the user ever cancelled.

    A conditional max in a hash aggregate (partial per map task), instead of
    collecting the ids of cancelled users to the driver.
    """
    return (drop_blank_users(events, spec).groupBy(spec.user)
            .agg(F.max(flag_page(spec.page, spec.cancel_page)).alias("churn")))


def churn_label_rows(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, salts: int = SALTS) -> DataFrame:
    """Row form: every row of a user carries the user's label.

    The cancellation rows are filtered at the scan and reduced to the users
    who cancelled, a side that is far smaller than the users; that flag is left
    joined with ``salted_join``, so a user with very many rows is spread over
    many join tasks.
    """
    clean = drop_blank_users(events, spec)
    cancelled = (clean.where(F.col(spec.page) == F.lit(spec.cancel_page)).select(spec.user).distinct()
                 .withColumn("churn", F.lit(1)))
    out = salted_join(clean, cancelled, spec.user, (spec.ts, spec.page), "left", salts)
    return out.withColumn("churn", F.coalesce("churn", F.lit(0)))
