"""Declared schemas and the column/page mapping of an activity log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Event log: one row per user action; ts is epoch milliseconds (UTC).
EVENT = T.StructType([
    T.StructField("userId", T.StringType(), True),
    T.StructField("page", T.StringType(), True),
    T.StructField("ts", T.LongType(), True),
    T.StructField("level", T.StringType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
])

# Per-user feature table; the column order is the positional order of the
# headerless CSV hand-off, so it is part of the contract.
FEATURES = T.StructType([
    T.StructField("userId", T.StringType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("churn", T.IntegerType(), True),
    T.StructField("last_level", T.StringType(), True),
    T.StructField("days_active", T.IntegerType(), True),
    T.StructField("last_state", T.StringType(), True),
    T.StructField("avg_songs", T.DoubleType(), True),
    T.StructField("avg_events", T.DoubleType(), True),
    T.StructField("thumbs_up", T.LongType(), True),
    T.StructField("thumbs_down", T.LongType(), True),
    T.StructField("addfriend", T.LongType(), True),
])

FEATURE_COLUMNS = [f.name for f in FEATURES.fields]
CATEGORICAL = ["gender", "last_level", "last_state"]
NUMERIC = ["days_active", "avg_songs", "avg_events", "thumbs_up", "thumbs_down", "addfriend"]


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns and page names of an activity log carry which meaning."""

    user: str = "userId"
    page: str = "page"
    ts: str = "ts"
    level: str = "level"
    gender: str = "gender"
    location: str = "location"
    # Page names of the music-service log.
    song_page: str = "NextSong"
    thumbs_up_page: str = "Thumbs Up"
    thumbs_down_page: str = "Thumbs Down"
    add_friend_page: str = "Add Friend"
    cancel_page: str = "Cancellation Confirmation"


DEFAULT_SPEC = FeatureSpec()
