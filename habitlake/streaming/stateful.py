"""Stateful stream processors.

State is small: (points, goal, tracker) per user-day for goals, (expiry,
used) per token, (last day, current, longest) per user for streaks, and the
events that the watermark has not passed yet. Goals and tokens apply events
in event order whatever order they arrive in (:mod:`.ordered`) and equal
their batch twins (G2, G4, U4); streaks equal F2 when days arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.exprs import REMINDER_EVERY_HOURS
from .ordered import GROUP_STATE, NEVER, InOrder, group_of, load, save

_DAY_US = 86_400_000_000
NO_KEY = -NEVER  # stands for a NULL key inside the processors

# ------------------------------------------------------------------ L3 ----
STREAK_OUT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("day_num", T.IntegerType()),
                           T.StructField("streak_count", T.IntegerType()),
                           T.StructField("is_streak_record", T.BooleanType())])


def _streak_fn(_, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The streaks of a group of users: (last day, current, longest) per user."""
    days = sorted({d for pdf in pdfs for d in zip(pdf["user_id"].tolist(), pdf["day_num"].tolist())})
    kept = load(state) or {}
    out = []
    for user, d in days:
        last, cur, longest = kept.get(user, (None, 0, 0))
        if last is not None and d <= last:
            continue  # a late earlier day does not rewrite the streak
        cur = cur + 1 if last is not None and d == last + 1 else 1
        out.append((user, d, cur, cur > longest))
        kept[user] = (d, cur, max(longest, cur))
    save(state, kept)
    yield pd.DataFrame(out, columns=STREAK_OUT.names)


def streak_stream(logs: DataFrame) -> DataFrame:
    """L3: streak count and record flag on each user's first log of a day
    (the stream twin of F2; the last row per user is F1's state). Users are
    dealt to groups (:mod:`.ordered`), one state row each."""
    days = logs.select(F.coalesce("user_id", F.lit(NO_KEY)).alias("user_id"), F.datediff(F.to_date("logged_at"), F.lit("1970-01-01")).alias("day_num")).where("day_num IS NOT NULL")
    out = days.withColumn("_group", group_of("user_id")).groupBy("_group").applyInPandasWithState(
        _streak_fn, STREAK_OUT, GROUP_STATE, "append", GroupStateTimeout.NoTimeout)
    return out.select(F.nullif("user_id", F.lit(NO_KEY)).alias("user_id"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day_num")).alias("date"),
                      "streak_count", "is_streak_record")


# -------------------------------------------------------------- L2 + L4 ----
GOAL_OUT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("user_id", T.LongType()),
    T.StructField("day_num", T.IntegerType()), T.StructField("id", T.LongType()),
    T.StructField("at_us", T.LongType()), T.StructField("transition", T.StringType()),
    T.StructField("total_points", T.LongType()), T.StructField("goal_points", T.IntegerType())])
GOAL_SET, LOGGED = 0, 1  # kinds of events


class GoalDay(InOrder):
    """One user-day: points so far, the day's goal, and the tracker's next tick."""

    keys = ("user_id", "day_num")
    payload = ("points",)
    fresh = (0, -1, NEVER, NEVER)  # total, goal (negative: none set), since when, next tick
    out = GOAL_OUT

    def __init__(self, every_us: int):
        self.every_us = every_us

    @staticmethod
    def _end(key) -> int:
        return (int(key[1]) + 1) * _DAY_US

    def until(self, key, state, us, out):
        total, goal, goal_at, tick = state
        while tick < min(us, self._end(key)):
            out.append(("reminder", key[0], key[1], None, tick, None, total, max(goal, 0)))
            tick += self.every_us
        return total, goal, goal_at, tick if tick < self._end(key) else NEVER

    def apply(self, key, state, event, out):
        total, goal, goal_at, tick = state
        at, kind, eid, pts = event
        if kind == GOAL_SET:  # it becomes the day's goal and (re)starts the tracker
            return total, pts, min(goal_at, at), at + self.every_us
        total += pts
        if goal > 0:
            if total + pts > goal and not total > goal:
                out.append(("transition", key[0], key[1], eid, at, "completed", total, goal))
                tick = NEVER
            elif goal > total + pts and total > goal:
                out.append(("transition", key[0], key[1], eid, at, "uncompleted", total, goal))
                tick = at + self.every_us
        return total, goal, goal_at, tick

    def wake(self, key, state):
        return state[3] + 1 if state[3] < NEVER else self._end(key)

    def over(self, key, state, us):
        return us >= self._end(key)


def goal_events(logs: DataFrame, goals: DataFrame) -> DataFrame:
    """One event table of goals set (kind 0) and logs (kind 1) — the input
    of :func:`goal_stream`, batch or stream."""
    return (goals.select("user_id", F.col("created_at").alias("at"), F.lit(GOAL_SET).alias("kind"), "id",
                         F.col("goal_points").cast("bigint").alias("points"))
            .unionByName(logs.select("user_id", F.col("logged_at").alias("at"), F.lit(LOGGED).alias("kind"), "id",
                                     F.col("points").cast("bigint").alias("points"))))


def goal_stream(events: DataFrame, late: str = "1 hour", every_hours: int = REMINDER_EVERY_HOURS) -> DataFrame:
    """L2 + L4: goal status flips as logs arrive (reference mode, the twin
    of G2) and reminders every ``every_hours`` after a tracker starts (the
    twin of G4), from one event stream of goals and logs (see
    :func:`goal_events`) keyed by user-day.

    Events wait in state until the watermark has passed them and are applied
    in event order (:mod:`.ordered`), so files may arrive in any order within
    ``late``, and a late row of one day leaves every other day alone. State
    is cleared when the watermark passes the end of the day."""
    ev = events.withColumn("et", F.col("at").cast("timestamp")).withWatermark("et", late).select(
        F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.datediff(F.to_date("at"), F.lit("1970-01-01")).alias("day_num"),
        "et", F.unix_micros("et").alias("at_us"), "kind", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("points", F.lit(0)).alias("points"))
    out = GoalDay(every_hours * 3_600_000_000).run(ev.where(F.col("at_us").isNotNull()))
    return out.select("kind", "user_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day_num")).alias("date"),
                      "id", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("at"), "transition",
                      "total_points", "goal_points")


# ------------------------------------------------------------------ L6 ----
RESET_OUT = T.StructType([T.StructField("attempt_id", T.LongType()), T.StructField("token", T.LongType()),
                          T.StructField("outcome", T.StringType()), T.StructField("email", T.StringType())])
RESET_SET, ATTEMPT = 0, 1  # kinds of events


class TokenUse(InOrder):
    """One token: until when it is good, whose it is, and whether it was used."""

    keys = ("token",)
    payload = ("expires_us", "email")
    fresh = (-NEVER, "", 0)  # good until, whose, used: no such token
    out = RESET_OUT

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def until(self, key, state, us, out):
        return state

    def apply(self, key, state, event, out):
        at, kind, eid, expires, email = event
        if kind == RESET_SET:
            return expires, email, 0
        known, used = state[0] > -NEVER, state[2]
        if not known or used:
            out.append((eid, key[0], "invalid", None))
        elif at > state[0]:
            out.append((eid, key[0], "expired", None))
        else:
            out.append((eid, key[0], "valid", state[1]))
            return state[0], state[1], 1
        return state

    def wake(self, key, state):
        return state[0] + self.keep_us + 1 if state[0] > -NEVER else NEVER

    def over(self, key, state, us):
        return us > state[0] + self.keep_us


def reset_events(attempts: DataFrame, resets: DataFrame, users: DataFrame) -> DataFrame:
    """One event table of tokens issued (kind 0) and attempts (kind 1) — the
    input of :func:`reset_redeem_stream`. Tokens carry their user's email;
    a token whose user is gone is unknown."""
    owner = users.select(F.col("id").alias("user_id"), "email")
    return (resets.join(owner, "user_id").select("token", F.col("created_at").alias("at"), F.lit(RESET_SET).alias("kind"),
                                                 F.lit(0).cast("bigint").alias("id"), "expires_at", "email")
            .unionByName(attempts.select("token", F.col("attempted_at").alias("at"), F.lit(ATTEMPT).alias("kind"),
                                         F.col("attempt_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("expires_at"),
                                         F.lit(None).cast("string").alias("email"))))


def reset_redeem_stream(events: DataFrame, late: str = "1 hour", keep_days: int = 30) -> DataFrame:
    """Every reset attempt with its outcome (the twin of U4): 'valid' for
    the first one in time, which uses the token up, 'expired', or 'invalid'
    (unknown or used). State is one small row per token, in event order
    (:mod:`.ordered`); it is kept ``keep_days`` beyond expiry, after which
    the token counts as unknown."""
    us = F.unix_micros(F.col("expires_at").cast("timestamp"))
    ev = events.withColumn("et", F.col("at").cast("timestamp")).withWatermark("et", late).select(
        F.coalesce("token", F.lit(NO_KEY)).alias("token"), "et", F.unix_micros("et").alias("at_us"), "kind", F.coalesce("id", F.lit(-1)).alias("id"),
        F.coalesce(us, F.lit(-NEVER)).alias("expires_us"), F.coalesce("email", F.lit("")).alias("email"))
    out = TokenUse(keep_days * _DAY_US).run(ev.where(F.col("at_us").isNotNull()))
    return out.withColumn("token", F.nullif("token", F.lit(NO_KEY)))
