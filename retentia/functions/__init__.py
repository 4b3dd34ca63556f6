"""Column expressions (JVM built-ins only; no Python UDFs)."""

from retentia.functions.columns import (
    event_date,
    flag_page,
    hash_bucket,
    missing_test,
    state_of,
)

__all__ = ["event_date", "flag_page", "hash_bucket", "missing_test", "state_of"]
