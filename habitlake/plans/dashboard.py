"""D7 — the daily dashboard for every user as one nested row.

One scan of the day's logs feeds a single conditional aggregate (points,
productive split, count); the latest-k list comes from a WindowGroupLimit
(top-k before and after the shuffle), so no user's whole day is ever
collected; streak state is joined by user_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import RECENT_K
from ..operators import daily as D
from ..operators import streaks as S


def daily_dashboard(logs: DataFrame, acts: DataFrame, goals: DataFrame, users: DataFrame,
                    as_of, k: int = RECENT_K, streak_state: DataFrame | None = None) -> DataFrame:
    r = D.day_user_rollup(logs, as_of)
    recent = (D.recent_activities(logs, acts, as_of, k)
              .groupBy("user_id")
              .agg(F.array_sort(F.collect_list(F.struct("rn", "duration", "points", "activity_description", "name")))
                   .alias("recent")))
    state = streak_state if streak_state is not None else S.streaks(logs, as_of)
    st = S.streak_status(state, users, as_of)
    goal = D.day_goal(goals, as_of)
    j = (st.join(r, "user_id", "left").join(goal, "user_id", "left").join(recent, "user_id", "left"))
    recent_t = "array<struct<duration:int,points:int,activity_description:string,name:string>>"
    return j.select(
        "user_id",
        F.coalesce("sum_points", F.lit(0)).cast("int").alias("total_points"),
        F.coalesce("goal_points", F.lit(0)).cast("int").alias("goal_points"),
        F.struct(F.coalesce("productive", F.lit(0)).cast("int").alias("productive_time"),
                 F.coalesce("unproductive", F.lit(0)).cast("int").alias("unproductive_time"))
        .alias("daily_productive_time"),
        F.coalesce(F.transform("recent", lambda x: F.struct(
            x["duration"].alias("duration"), x["points"].alias("points"),
            x["activity_description"].alias("activity_description"), x["name"].alias("name"))),
            F.array().cast(recent_t)).alias("recent_activities"),
        F.coalesce("n_logs", F.lit(0)).cast("bigint").alias("daily_activity_logs_count"),
        "current_streak", "longest_streak", "streak_message")


def flat_dashboard(dash: DataFrame) -> DataFrame:
    """D7 as flat columns (tabular sinks, SQL oracle)."""
    return dash.select(
        "user_id", "total_points", "goal_points",
        F.col("daily_productive_time.productive_time").alias("productive_time"),
        F.col("daily_productive_time.unproductive_time").alias("unproductive_time"),
        F.size("recent_activities").alias("n_recent"),
        F.aggregate("recent_activities", F.lit(0), lambda a, x: a + x["points"]).alias("recent_points"),
        "daily_activity_logs_count", "current_streak", "longest_streak", "streak_message")
