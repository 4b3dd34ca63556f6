"""Per-user behavioural features of an activity log.

Physical design of ``feature_table`` (one scan of the log, no join on events):

1. project: UTC day, state, cancel flag; drop rows without a user;
2. ``groupBy(user, day, level, state, gender)`` -- a hash aggregate over the
   raw rows (fixed-width buffers: counters, cancel flag, max ts), partial
   per map task, so at most one row per group and task is shuffled;
3. ``groupBy(user, day)``: sums of the counters and the day's last row,
   picked as the greatest ``struct(ts, complete, level, state, gender)``.  The
   struct holds strings, which forces a sort-based aggregate -- here it only
   sees the rows left after step 2, never the raw log;
4. ``groupBy(user)``: averages over days, sums, first/last day, last row;
5. keep users with at least one song day and a complete last row.

A user holding a large share of all rows is spread over partitions by day in
steps 2-3 and arrives at step 4 as at most one row per day.

The "last row" is the latest event, preferring a row whose level, state and
gender are all present, ties broken by the greater values -- exactly one row
per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.columns import event_date, flag_page, state_of
from retentia.operators.rows import drop_blank_users
from retentia.schema import DEFAULT_SPEC, FEATURE_COLUMNS, FeatureSpec
from retentia.session import materialize


def _is(spec: FeatureSpec, page: str) -> Column:
    return F.col(spec.page) == F.lit(page)


def value_partials(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, with_profile: bool = True) -> DataFrame:
    """Stage 1: one row per (user, day, level[, state, gender]) -- hash aggregate.

    Every column is combinable (counts, max flag, max ts), so partials of
    disjoint slices of the log (e.g. stream micro-batches) can simply be
    unioned and fed to ``days_from_partials``.
    """
    ev = drop_blank_users(events, spec)
    attrs = [F.col(spec.level).alias("level")]
    if with_profile:
        attrs += [state_of(spec.location).alias("state"), F.col(spec.gender).alias("gender")]
    return ev.groupBy(F.col(spec.user).alias("userId"), event_date(spec.ts).alias("date"), *attrs).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(_is(spec, spec.song_page)).alias("n_songs"),
        F.count_if(_is(spec, spec.thumbs_up_page)).alias("n_up"),
        F.count_if(_is(spec, spec.thumbs_down_page)).alias("n_down"),
        F.count_if(_is(spec, spec.add_friend_page)).alias("n_friend"),
        F.max(flag_page(spec.page, spec.cancel_page)).alias("churn"),
        F.max(spec.ts).alias("ts"),
    )


def days_from_partials(partials: DataFrame) -> DataFrame:
    """Stage 2: one row per (user, day): summed counters and the day's last row."""
    if "state" in partials.columns:
        complete = F.col("level").isNotNull() & F.col("gender").isNotNull() & F.col("state").isNotNull()
        last = F.struct("ts", complete.alias("complete"), "level", "state", "gender")
    else:
        last = F.struct("ts", "level")
    return partials.groupBy("userId", "date").agg(
        *[F.sum(c).alias(c) for c in ("n_events", "n_songs", "n_up", "n_down", "n_friend")],
        F.max("churn").alias("churn"),
        F.max(last).alias("last"),
    )


def daily_activity(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, with_profile: bool = True) -> DataFrame:
    """One row per (user, UTC day): counters, cancel flag and the day's last row."""
    return days_from_partials(value_partials(events, spec, with_profile))


def user_activity(daily: DataFrame) -> DataFrame:
    """Stage 3: one row per user from the daily rows."""
    return daily.groupBy("userId").agg(
        F.round(F.avg(F.when(F.col("n_songs") > 0, F.col("n_songs"))), 2).alias("avg_songs"),
        F.round(F.avg("n_events"), 2).alias("avg_events"),
        F.sum("n_up").alias("thumbs_up"),
        F.sum("n_down").alias("thumbs_down"),
        F.sum("n_friend").alias("addfriend"),
        F.max("churn").cast("int").alias("churn"),
        F.datediff(F.max("date"), F.min("date")).alias("days_active"),
        F.max("last").alias("last"),
    )


def feature_table(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, users: DataFrame | None = None) -> DataFrame:
    """The 11-column feature table, one row per user.

    ``events`` is a row-level activity log.  When ``users`` (user, gender,
    location) is given, the log carries no per-row gender/location: the facts
    are reduced first and the profile joins one row per user -- the plan for a
    star schema, where joining the profile onto every event would shuffle the
    whole log.
    """
    return features_from_days(daily_activity(events, spec, with_profile=users is None), spec, users)


def features_from_days(daily: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, users: DataFrame | None = None
                       ) -> DataFrame:
    """Per-user stage and final projection from (user, day) rows."""
    u = with_profile(user_activity(daily).where(F.col("avg_songs").isNotNull()), spec, users)
    return u.select(*FEATURE_COLUMNS)


def _profile(users: DataFrame, spec: FeatureSpec) -> DataFrame:
    return users.select(F.col(spec.user).alias("_u"), F.col(spec.gender).alias("_gender"),
                        state_of(spec.location).alias("_state"))


def with_profile(u: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, users: DataFrame | None = None) -> DataFrame:
    """Per-user rows with a complete last row, plus last_level, gender and last_state."""
    if users is None:
        u = u.where(F.col("last.complete"))
        gender, state = F.col("last.gender"), F.col("last.state")
    else:
        u = (u.join(_profile(users, spec), F.col("userId") == F.col("_u"), "inner")
             .where(F.col("last.level").isNotNull() & F.col("_gender").isNotNull() & F.col("_state").isNotNull()))
        gender, state = F.col("_gender"), F.col("_state")
    return u.withColumns({"last_level": F.col("last.level"), "gender": gender, "last_state": state})


# --------------------------------------------------------------------------
# Single features: each its own hash aggregate over the log (partial per
# task), as a separate query would compute it.
# --------------------------------------------------------------------------

def user_first_last(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """first/last ts, first/last UTC day and days_active per user."""
    ev = drop_blank_users(events, spec)
    return (ev.groupBy(spec.user)
            .agg(F.min(spec.ts).alias("first_ts"), F.max(spec.ts).alias("last_ts"))
            .withColumns({"first_date": event_date("first_ts"), "last_date": event_date("last_ts")})
            .withColumn("days_active", F.datediff("last_date", "first_date")))


def songs_per_day(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """(user, date, n_songs) for days with at least one song."""
    ev = drop_blank_users(events, spec).where(_is(spec, spec.song_page))
    return ev.groupBy(F.col(spec.user), event_date(spec.ts).alias("date")).agg(F.count(F.lit(1)).alias("n_songs"))


def events_per_day(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """(user, date, n_events) for days with any event."""
    ev = drop_blank_users(events, spec)
    return ev.groupBy(F.col(spec.user), event_date(spec.ts).alias("date")).agg(F.count(F.lit(1)).alias("n_events"))


def avg_songs(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    return (songs_per_day(events, spec).groupBy(spec.user)
            .agg(F.round(F.avg("n_songs"), 2).alias("avg_songs")))


def avg_events(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    return (events_per_day(events, spec).groupBy(spec.user)
            .agg(F.round(F.avg("n_events"), 2).alias("avg_events")))


def page_count(events: DataFrame, page: str, name: str, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """(user, name) for users with at least one row of ``page``."""
    ev = drop_blank_users(events, spec).where(_is(spec, page))
    return ev.groupBy(spec.user).agg(F.count(F.lit(1)).alias(name))


def thumbs_up(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    return page_count(events, spec.thumbs_up_page, "thumbs_up", spec)


def thumbs_down(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    return page_count(events, spec.thumbs_down_page, "thumbs_down", spec)


def add_friend(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    return page_count(events, spec.add_friend_page, "addfriend", spec)


def last_profile(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, users: DataFrame | None = None) -> DataFrame:
    """(userId, last_level, last_state, gender) from the user's last complete row.

    Same path as the feature table: hash aggregate per (user, day, values)
    over the raw rows, the string-bearing last-row pick only on reduced rows,
    the profile (``users``) joined on one row per user.
    """
    u = with_profile(user_activity(daily_activity(events, spec, with_profile=users is None)), spec, users)
    return u.select("userId", "last_level", "last_state", "gender")


# --------------------------------------------------------------------------
# Join form: the same table assembled from separate per-user branches joined
# on the user key (inner for songs/events, left + fill 0 for page counts).
# All branches start from one (user, day) table, so the log is scanned once
# when that table is materialised.  Kept as an equivalence check.
# --------------------------------------------------------------------------

def user_rows(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, users: DataFrame | None = None) -> DataFrame:
    """(user, gender, churn, last_level, days_active, last_state): the distinct rows at each user's last ts.

    Several per user when rows with different values tie at the last ts; rows
    with a NULL are kept (``rows.drop_null_rows`` drops them).  The log is
    reduced to one row per user and set of values before the last ts is looked
    up, so a user with any number of rows, or of rows at one ts, is a few rows.
    """
    ev = drop_blank_users(events, spec)
    attrs = [F.col(spec.level).alias("last_level")]
    if users is None:
        attrs += [F.col(spec.gender).alias("gender"), state_of(spec.location).alias("last_state")]
    per_value = ev.groupBy(F.col(spec.user).alias("userId"), *attrs).agg(
        F.max(flag_page(spec.page, spec.cancel_page)).cast("int").alias("churn"),
        F.min(spec.ts).alias("first_ts"), F.max(spec.ts).alias("last_ts"))
    w = Window.partitionBy("userId")
    at_last = (per_value.withColumns({"churn": F.max("churn").over(w), "first": F.min("first_ts").over(w),
                                      "last": F.max("last_ts").over(w)})
               .where(F.col("last_ts") == F.col("last"))
               .withColumn("days_active", F.datediff(event_date("last"), event_date("first"))))
    if users is not None:
        at_last = at_last.join(_profile(users, spec), F.col("userId") == F.col("_u"), "left").withColumns(
            {"gender": F.col("_gender"), "last_state": F.col("_state")})
    return at_last.select(F.col("userId").alias(spec.user), "gender", "churn", "last_level", "days_active", "last_state")


def user_base(daily: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, users: DataFrame | None = None) -> DataFrame:
    """(userId, gender, churn, last_level, days_active, last_state): one complete last row per user."""
    u = with_profile(user_activity(daily), spec, users)
    return u.select("userId", "gender", "churn", "last_level", "days_active", "last_state")


def join_songs_inner(base: DataFrame, daily: DataFrame) -> DataFrame:
    """Inner join to avg_songs: users who never played a song drop out."""
    songs = (daily.where(F.col("n_songs") > 0).groupBy("userId")
             .agg(F.round(F.avg("n_songs"), 2).alias("avg_songs")))
    return base.join(songs, "userId", "inner")


def join_events_inner(base: DataFrame, daily: DataFrame) -> DataFrame:
    events = daily.groupBy("userId").agg(F.round(F.avg("n_events"), 2).alias("avg_events"))
    return base.join(events, "userId", "inner")


def join_counts_left(base: DataFrame, daily: DataFrame) -> DataFrame:
    """Left joins to the three page counts, missing counts filled with 0."""
    out = base
    names = {"n_up": "thumbs_up", "n_down": "thumbs_down", "n_friend": "addfriend"}
    for source, name in names.items():
        part = daily.where(F.col(source) > 0).groupBy("userId").agg(F.sum(source).alias(name))
        out = out.join(part, "userId", "left")
    return out.na.fill(0, subset=list(names.values()))


def feature_table_joinform(events: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, users: DataFrame | None = None
                           ) -> DataFrame:
    """The feature table by joins; runs the job of the (user, day) table when called."""
    daily = materialize(daily_activity(events, spec, with_profile=users is None))
    base = user_base(daily, spec, users)
    out = join_counts_left(join_events_inner(join_songs_inner(base, daily), daily), daily)
    return out.select(*FEATURE_COLUMNS)
