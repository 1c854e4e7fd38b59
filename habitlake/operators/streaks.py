"""Logging streaks.

The reference updates (current, longest, last date) on the first log of
each day. Replayed over the whole log this is gaps-and-islands: distinct
user-days, ``day - row_number()`` is constant along a run of consecutive
days. Windows only ever see one row per user-day, so a very active user
costs no more than a quiet one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_date, date_lit, ts_lit

# The reference's streak messages, verbatim.
MSG_WELCOME = "Welcome here ! You can start a productivity streak by setting activities daily!🚀"
MSG_AT_ZERO = "😢 Oh no, your streak is at 0! But guess what? Today is a new chance to start strong! 🌟 Dive back in and build it up! 💪"  # noqa: E501
MSG_ON_A_ROLL = "🎉 You're on a roll! You've completed your daily streak today! Keep up the amazing work! 🔥💪"
MSG_ON_A_STREAK = "🔥 You're on a streak! Don't forget to log an activity today to keep it going! You’ve got this! 💪✨"


def logged_days(logs: DataFrame, as_of=None) -> DataFrame:
    """Distinct (user_id, day); partial aggregation dedupes before the shuffle."""
    if as_of is not None:
        if "log_date" in logs.columns:  # partitioned log table: skip later partitions
            logs = logs.where(F.col("log_date") <= date_lit(as_of))
        logs = logs.where(F.col("logged_at") < ts_lit(as_date(as_of) + dt.timedelta(days=1)))
    return logs.select("user_id", F.to_date("logged_at").alias("day")).distinct()


def _islands(days: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("day")
    return days.withColumn("island", F.date_sub("day", F.row_number().over(w)))


def streaks(logs: DataFrame, as_of=None) -> DataFrame:
    """(current_streak, longest_streak, last_logged_date) per user after
    replaying every logged day up to ``as_of``."""
    isl = (_islands(logged_days(logs, as_of))
           .groupBy("user_id", "island")
           .agg(F.count(F.lit(1)).cast("int").alias("len"), F.max("day").alias("end")))
    return isl.groupBy("user_id").agg(
        F.max_by("len", "end").alias("current_streak"),
        F.max("len").alias("longest_streak"),
        F.max("end").alias("last_logged_date"))


def streak_records(logs: DataFrame, as_of=None) -> DataFrame:
    """per user-day the streak count after the day's first log and
    whether it beats every earlier count (the reference's record flag)."""
    isl = _islands(logged_days(logs, as_of))
    w_isl = Window.partitionBy("user_id", "island").orderBy("day")
    w_before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    c = isl.withColumn("streak_count", F.row_number().over(w_isl).cast("int"))
    return c.select(
        "user_id", F.col("day").alias("date"), "streak_count",
        (F.col("streak_count") > F.coalesce(F.max("streak_count").over(w_before), F.lit(0)))
        .alias("is_streak_record"))


def streak_status(streak_state: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """streak as seen on ``as_of``: decays to 0 when the last logged
    day is before yesterday (or unknown), with the reference's message."""
    d = date_lit(as_of)
    s = streak_state.select("user_id", "current_streak", "longest_streak", "last_logged_date",
                            F.lit(True).alias("_has"))
    j = users.select(F.col("id").alias("user_id")).join(s, "user_id", "left")
    last = F.col("last_logged_date")
    gap = F.datediff(d, last)
    stale = last.isNull() | (gap > 1)
    msg = (F.when(F.col("_has").isNull(), F.lit(MSG_WELCOME))
           .when(stale, F.lit(MSG_AT_ZERO))
           .when(gap == 0, F.lit(MSG_ON_A_ROLL))
           .when(gap == 1, F.lit(MSG_ON_A_STREAK))
           .otherwise(F.lit("")))
    cur = F.when(F.col("_has").isNull() | stale, F.lit(0)).otherwise(F.col("current_streak"))
    return j.select("user_id", cur.cast("int").alias("current_streak"),
                    F.coalesce("longest_streak", F.lit(0)).cast("int").alias("longest_streak"),
                    msg.alias("streak_message"))


def upsert_streaks(state: DataFrame, updates: DataFrame) -> DataFrame:
    """INSERT ... ON CONFLICT (user_id) DO UPDATE as a join: where an
    update exists its whole row wins (an update may set NULL), else the
    old row stays. One shuffle on user_id for both sides."""
    cols = ["current_streak", "longest_streak", "last_logged_date"]
    u = updates.select("user_id", *[F.col(c).alias(f"u_{c}") for c in cols], F.lit(True).alias("_u"))
    j = state.join(u, "user_id", "full_outer")
    return j.select("user_id", *[F.when(F.col("_u"), F.col(f"u_{c}")).otherwise(F.col(c)).alias(c)
                                 for c in cols])
