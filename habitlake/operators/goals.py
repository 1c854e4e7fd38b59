"""Productivity goals — setting, status flips, final status, reminders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import REMINDER_EVERY_HOURS, as_date, prune_days, ts_lit
from ..functions.windows import running_sum

# RFC 3339: date, 'T', time, any fraction of a second, and 'Z' or a numeric offset.
RFC3339 = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def set_goals(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: parse goal_date (RFC 3339) and append goals with status
    'not completed'. The date is the one written, in its own offset, as a
    DATE column takes it: 2024-01-15T00:30:00+02:00 is 2024-01-15. The
    reference ignores a parse error and stores year 1; here such rows go to
    the rejects frame with a reason."""
    plain = F.concat(F.regexp_extract("goal_date", RFC3339, 1), F.regexp_extract("goal_date", RFC3339, 2))
    parsed = requests.withColumn("_ts", F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    goals = parsed.where(F.col("_ts").isNotNull()).select(
        "id", "user_id", F.substring("goal_date", 1, 10).cast("date").alias("goal_date"), F.col("goal_points").cast("int").alias("goal_points"),
        F.col("requested_at").alias("created_at"), F.lit("not completed").alias("status"))
    rejects = parsed.where(F.col("_ts").isNull()).select(
        "id", "user_id", "goal_date", F.lit("invalid goal_date").alias("reason"))
    return goals, rejects


def day_goals(goals: DataFrame) -> DataFrame:
    """(user_id, date) → goal points (latest goal by created_at, id) and the
    first moment a goal row exists that day. The goal day is
    DATE(created_at), as in the reference, not goal_date."""
    return (goals.groupBy("user_id", F.to_date("created_at").alias("date"))
            .agg(F.max_by("goal_points", F.struct("created_at", "id")).alias("goal_points"),
                 F.min("created_at").alias("goal_at")))


def in_days(logs: DataFrame, goals: DataFrame, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """Logs and goals of the days [start, end) (dates; None: all), as ranges
    that reach the scans: a goal belongs to the day it was created on."""
    for bound, keep in ((start, lambda c: c >= ts_lit(as_date(start))), (end, lambda c: c < ts_lit(as_date(end)))):
        if bound is not None:
            logs, goals = logs.where(keep(F.col("logged_at"))), goals.where(keep(F.col("created_at")))
    if start is not None and end is not None:
        logs = prune_days(logs, as_date(start), as_date(end))
    return logs, goals


def goal_transitions(logs: DataFrame, goals: DataFrame, mode: str = "reference",
                     p_col: str = "points", start=None, end=None) -> DataFrame:
    """For each log in (logged_at, id) order within its user-day, does
    the day's goal status flip?

    ``after`` is the running point sum including the log, ``p`` the log's
    ``p_col``, ``g`` the goal (> 0 only). Only logs at or after the goal's
    creation can flip it. ``mode='reference'`` reproduces the reference's
    test, which adds ``p`` a second time; ``mode='intent'`` is the plain
    crossing test. Only user-days with such a goal are summed at all (a
    semi-join before the first shuffle of logs by order), of the days
    [start, end) if given. The running sum is chunked by minute so a very
    active user-day is spread over many tasks."""
    logs, goals = in_days(logs, goals, start, end)
    aimed = day_goals(goals).where(F.col("goal_points") > 0)
    lg = logs.select("id", "user_id", "logged_at", "points", F.col(p_col).alias("_p"),
                     F.to_date("logged_at").alias("date")).join(aimed.select("user_id", "date"), ["user_id", "date"], "left_semi")
    rs = running_sum(lg, ["user_id", "date"], ["logged_at", "id"], "points", "after",
                     chunk=F.date_trunc("minute", F.col("logged_at")))
    j = rs.join(aimed, ["user_id", "date"]).where(F.col("logged_at") >= F.col("goal_at"))
    a, p, g = F.col("after"), F.col("_p"), F.col("goal_points")
    if mode == "reference":
        done = (a + p > g) & ~(a > g)
        undone = (g > a + p) & (a > g)
    elif mode == "intent":
        done = (a > g) & (a - p <= g)
        undone = (a < g) & (a - p > g)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    t = F.when(done, F.lit("completed")).when(undone, F.lit("uncompleted"))
    return (j.select("user_id", "date", "id", "logged_at", t.alias("transition"))
            .where(F.col("transition").isNotNull()))


def goal_status(goals: DataFrame, transitions: DataFrame) -> DataFrame:
    """Final status of every goal: the day's last flip (by logged_at,
    id) applies to all goals created that day; otherwise the stored one."""
    last = (transitions.groupBy("user_id", "date")
            .agg(F.max_by("transition", F.struct("logged_at", "id")).alias("last")))
    g = goals.select(F.col("id").alias("goal_id"), "user_id", F.to_date("created_at").alias("date"), "status")
    j = g.join(last, ["user_id", "date"], "left")
    st = (F.when(F.col("last") == "completed", F.lit("completed"))
          .when(F.col("last") == "uncompleted", F.lit("not completed"))
          .otherwise(F.col("status")))
    return j.select("goal_id", "user_id", "date", st.alias("status"))


def goal_reminders(goals: DataFrame, transitions: DataFrame, logs: DataFrame,
                   every_hours: int = REMINDER_EVERY_HOURS, start=None, end=None) -> DataFrame:
    """Reminders every ``every_hours`` after a tracker starts (a goal is
    set, or the goal flips back to uncompleted) until the day ends, the goal
    completes, or a new tracker replaces it. Each reminder reports the
    points so far and the goal.

    Trackers come from a ``lead`` over the few start/stop events of a
    user-day; ticks from ``sequence`` (at most 24/every per tracker); the
    points at each tick from a union with the logs of goal days (no other
    day has a tick) and one running sum, so no log × tick product is
    formed. ``start`` and ``end`` as for the transitions given."""
    logs, goals = in_days(logs, goals, start, end)
    # one pass over the flips: 'uncompleted' restarts a tracker, 'completed' stops it
    flips = transitions.select("user_id", "date", F.col("logged_at").alias("at"),
                               (F.col("transition") == "uncompleted").cast("int").alias("is_start"))
    ev = goals.select("user_id", F.to_date("created_at").alias("date"), F.col("created_at").alias("at"),
                      F.lit(1).alias("is_start")).unionByName(flips)
    w = Window.partitionBy("user_id", "date").orderBy("at", "is_start")
    day_end = (F.col("date") + F.lit(1)).cast("timestamp_ntz")
    trk = (ev.withColumn("end", F.coalesce(F.lead("at").over(w), day_end))
           .where(F.col("is_start") == 1))
    step = F.expr(f"INTERVAL {every_hours} HOURS")
    first = F.col("at") + step
    ticks = (trk.where(first < F.col("end"))
             .select("user_id", "date", F.explode(F.sequence(first, F.col("end"), step)).alias("tick"), "end")
             .where(F.col("tick") < F.col("end"))
             .select("user_id", "date", "tick"))
    # as-of points: logs (kind 0) sort before a tick (kind 1) at the same instant
    days = goals.select("user_id", F.to_date("created_at").alias("date")).distinct()
    pts = (logs.select("user_id", F.to_date("logged_at").alias("date"), F.col("logged_at").alias("at"),
                       F.col("points").cast("bigint").alias("v"), F.lit(0).alias("kind"), F.col("id").alias("seq"))
           .join(days, ["user_id", "date"], "left_semi"))
    tk = ticks.select("user_id", "date", F.col("tick").alias("at"), F.lit(0).cast("bigint").alias("v"),
                      F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("seq"))
    both = running_sum(pts.unionByName(tk), ["user_id", "date"], ["at", "kind", "seq"], "v", "total",
                       chunk=F.date_trunc("minute", F.col("at")))
    dg = day_goals(goals).select("user_id", "date", "goal_points")
    return (both.where(F.col("kind") == 1)
            .join(dg, ["user_id", "date"], "left")
            .select("user_id", F.col("at").alias("tick_at"), F.col("total").alias("total_points"),
                    F.coalesce("goal_points", F.lit(0)).alias("goal_points")))
