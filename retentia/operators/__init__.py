"""DataFrame -> DataFrame operators (lazy; no actions unless stated)."""
