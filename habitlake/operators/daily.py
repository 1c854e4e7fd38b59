"""Daily rollups for one ``as_of`` day, all users in one pass.

The reference runs five point queries per user and request; here the day's
logs are scanned once (date range pushed to the scan), partially aggregated
map-side per user and shuffled as one small row per user and map task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import RECENT_K, as_date, null_split_left_join, on_day, prune_days


def day_logs(logs: DataFrame, as_of) -> DataFrame:
    d = as_date(as_of)
    return prune_days(logs, d, d + dt.timedelta(days=1)).where(on_day(F.col("logged_at"), as_of))


def _names(acts: DataFrame) -> DataFrame:
    return acts.select(F.col("id").alias("activity_id"), "name")


def daily_logs(logs: DataFrame, acts: DataFrame, as_of) -> DataFrame:
    """The day's logs with the activity name (NULL for one-time logs)."""
    d = day_logs(logs, as_of).select("id", "user_id", "activity_id", "duration", "points",
                                     "activity_description")
    return null_split_left_join(d, _names(acts), "activity_id").select(
        "id", "user_id", "activity_id", "name", "duration", "points", "activity_description")


def day_user_rollup(logs: DataFrame, as_of) -> DataFrame:
    """Every per-user daily measure from one scan and one aggregate."""
    p, d = F.col("points"), F.col("duration")
    return day_logs(logs, as_of).groupBy("user_id").agg(
        F.sum(p).alias("sum_points"),
        F.sum(F.when(p > 0, d).otherwise(0)).alias("productive"),
        F.sum(F.when(p < 0, d).otherwise(0)).alias("unproductive"),
        F.count(F.lit(1)).alias("n_logs"),
        F.sum(d).alias("minutes"),
    )


def day_goal(goals: DataFrame, as_of) -> DataFrame:
    """Goal of the day per user. The goal day is DATE(created_at); with
    several goals that day the latest by (created_at, id) wins (the
    reference's scalar subquery would fail there)."""
    g = goals.where(on_day(F.col("created_at"), as_of))
    return g.groupBy("user_id").agg(
        F.max_by("goal_points", F.struct("created_at", "id")).alias("goal_points"))


def _all_users(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id"))


def daily_points(logs, goals, users, as_of, rollup: DataFrame | None = None) -> DataFrame:
    """Total points and goal points of the day, 0 when absent."""
    r = rollup if rollup is not None else day_user_rollup(logs, as_of)
    return (_all_users(users).join(r, "user_id", "left").join(day_goal(goals, as_of), "user_id", "left")
            .select("user_id",
                    F.coalesce("sum_points", F.lit(0)).cast("int").alias("total_points"),
                    F.coalesce("goal_points", F.lit(0)).cast("int").alias("goal_points")))


def daily_productive_time(logs, users, as_of, rollup=None) -> DataFrame:
    """D3: minutes with points > 0 and < 0 (points = 0 count in neither)."""
    r = rollup if rollup is not None else day_user_rollup(logs, as_of)
    return _all_users(users).join(r, "user_id", "left").select(
        "user_id",
        F.coalesce("productive", F.lit(0)).cast("int").alias("productive_time"),
        F.coalesce("unproductive", F.lit(0)).cast("int").alias("unproductive_time"))


def recent_activities(logs, acts, as_of, k: int = RECENT_K) -> DataFrame:
    """Latest k logs of the day per user, newest first.

    ``row_number() <= k`` is planned as a WindowGroupLimit, applied before
    the shuffle too, so a very active user sends at most k rows per map
    task. The name join runs after the cut, on k rows per user."""
    w = Window.partitionBy("user_id").orderBy(F.col("logged_at").desc(), F.col("id").desc())
    top = (day_logs(logs, as_of)
           .select("id", "user_id", "activity_id", "duration", "points", "activity_description", "logged_at")
           .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k))
    return null_split_left_join(top, _names(acts), "activity_id").select(
        "user_id", "rn", "duration", "points", "activity_description", "name")


def daily_log_count(logs, users, as_of, rollup=None) -> DataFrame:
    """Number of logs of the day."""
    r = rollup if rollup is not None else day_user_rollup(logs, as_of)
    return _all_users(users).join(r, "user_id", "left").select(
        "user_id", F.coalesce("n_logs", F.lit(0)).cast("bigint").alias("daily_activity_count"))


def daily_minutes(logs, users, as_of, rollup=None) -> DataFrame:
    """Minutes logged in the day (the reference names it total_hours)."""
    r = rollup if rollup is not None else day_user_rollup(logs, as_of)
    return _all_users(users).join(r, "user_id", "left").select(
        "user_id", F.coalesce("minutes", F.lit(0)).cast("bigint").alias("total_minutes"))


def activity_catalog(acts: DataFrame) -> DataFrame:
    """Each user's activities, best points first (id breaks ties)."""
    w = Window.partitionBy("user_id").orderBy(F.col("points").desc(), F.col("id"))
    return acts.select("user_id", "id", "name", "points", "activity_type",
                       F.row_number().over(w).alias("pos"))


def activity_has_logs(pairs: DataFrame, logs: DataFrame) -> DataFrame:
    """Does (user_id, activity_id) have any log. NULL never matches.

    The logs side is reduced to its distinct keys first (partial aggregate
    before the shuffle), then flagged onto the pairs with a left join."""
    keys = (logs.where(F.col("activity_id").isNotNull())
            .groupBy("user_id", "activity_id").agg(F.max(F.lit(True)).alias("_hit")))
    return (pairs.join(keys, ["user_id", "activity_id"], "left")
            .select("user_id", "activity_id", F.coalesce("_hit", F.lit(False)).alias("log_exists")))
