"""Incremental (Structured Streaming) form of the feature job."""

from retentia.streaming.daily import features_from_partials, start_partials_stream

__all__ = ["features_from_partials", "start_partials_stream"]
