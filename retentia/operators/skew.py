"""Joining a per-key table back onto rows when one key may hold a large share of rows.

A join keyed by the user alone sends all rows of a user to one task.  Here every
key is split into ``salts`` sub-keys, always: a row's salt is a hash of its
``spread`` columns (deterministic, so a task recomputed after an executor loss
salts identically) and the per-key row is replicated once per salt.  Nothing is
counted first and nothing is broadcast; the cost is ``salts`` times the per-key
table, which has one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(rows: DataFrame, per_key: DataFrame, key: str | list[str], spread: tuple, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``per_key`` (one row per key); equals ``rows.join(per_key, key, how)``.

    ``key``: a column or several; ``spread``: columns or expressions that are the
    same whenever a row is computed.
    """
    keys = [key] if isinstance(key, str) else list(key)
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
