"""Activity log over the star-schema test tables.

``events`` x ``customer`` x ``nation`` is mapped onto the event-log columns
(userId, page, ts, level, gender, location).  The mapping rules are fixed so
that the DuckDB oracle can restate them; every event row is kept.

Two shapes are offered:

* ``activity_log`` -- the whole row-level log (one row per event), the input
  of every row-level operator and of the generic feature builder.
* ``activity_parts`` -- the same log split into its fact part (userId, page,
  ts, level) and its per-user dimension (userId, gender, location).  Gender
  and location are customer attributes, so the feature builder can reduce the
  facts first and join the dimension on one row per user instead of on every
  event (see ``operators.features.feature_table``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# event_type -> page name; 'error' becomes the cancellation page
# when value > 200, else 'Error'.
PAGE_OF_EVENT = [
    ("click", "NextSong"),
    ("view", "Thumbs Up"),
    ("purchase", "Thumbs Down"),
    ("signup", "Add Friend"),
]
CANCEL_VALUE = 200.0
PAID_VALUE = 35.0
# Derivation of "no user" rows: event ids divisible by 97 carry '' and those
# divisible by 101 carry NULL.  A value rule, not a sample: no row is dropped.
BLANK_USER_DIVISOR = 97
NULL_USER_DIVISOR = 101


# Users (by id) who never use a page: their rows of that page become NO_PAGE, so
# some users have no song, no thumbs or no friends at all.
NO_PAGE = "Help"
PAGE_SKIPPED_BY = {"NextSong": 23, "Thumbs Up": 13, "Thumbs Down": 17, "Add Friend": 11}
# Users whose clock has whole days only: their rows of a day share one ts (ties at the last ts).
DAY_CLOCK_DIVISOR = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame; the files are listed anew on every call."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _page() -> F.Column:
    et = F.col("event_type")
    expr = F.when(et == "error", F.when(F.col("value") > CANCEL_VALUE, F.lit("Cancellation Confirmation"))
                  .otherwise(F.lit("Error")))
    for src, page in PAGE_OF_EVENT:
        skipped = F.col("user_id") % PAGE_SKIPPED_BY[page] == 0
        expr = expr.when(et == src, F.when(skipped, F.lit(NO_PAGE)).otherwise(F.lit(page)))
    return expr


def _ts() -> F.Column:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").cast("bigint")
    day = F.col("user_id") % DAY_CLOCK_DIVISOR == 0
    return F.when(day, ms - F.pmod(ms, F.lit(86_400_000))).otherwise(ms)


def _user_id() -> F.Column:
    eid = F.col("event_id")
    return (F.when(eid % BLANK_USER_DIVISOR == 0, F.lit(""))
            .when(eid % NULL_USER_DIVISOR == 0, F.lit(None).cast("string"))
            .otherwise(F.col("user_id").cast("string")))


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, userId, page, ts, level): one row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id"),
        _user_id().alias("userId"),
        _page().alias("page"),
        _ts().alias("ts"),
        F.when(F.col("value") >= PAID_VALUE, F.lit("paid")).otherwise(F.lit("free")).alias("level"),
    )


def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, gender, location) per customer."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    gender = F.when(F.col("c_custkey") % 2 == 0, F.lit("F")).when(F.col("c_custkey") % 2 == 1, F.lit("M"))
    location = F.concat(
        F.lit("Metro-"), F.col("n_name"), F.lit(", "),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("ZZ-")).otherwise(F.lit("")),
        F.expr("chr(65 + n_nationkey)"), F.lit("X"))
    # nation is a dimension of the schema; its join strategy is left to the
    # optimizer, which broadcasts it from its measured size.
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left")
            .select("c_custkey", gender.alias("gender"), location.alias("location")))


def with_users(facts: DataFrame, users: DataFrame) -> DataFrame:
    """Fact rows with their profile columns, in the EVENT schema."""
    return (facts.join(users, facts.user_id == users.c_custkey, "left")
            .select("userId", "page", "ts", "level", "gender", "location"))


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole row-level event log with the EVENT schema."""
    return with_users(event_facts(spark, sf_dir), user_profile(spark, sf_dir))


def activity_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(facts, users): facts (userId, page, ts, level); users (userId, gender, location)."""
    facts = event_facts(spark, sf_dir).select("userId", "page", "ts", "level")
    users = user_profile(spark, sf_dir).select(
        F.col("c_custkey").cast("string").alias("userId"), "gender", "location")
    return facts, users
