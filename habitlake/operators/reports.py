"""Productivity reports over ``[start, end)`` for all users.

Everything comes from one user-day rollup of the logs in range: the first
level groups by (user_id, day) with map-side partial aggregation, so a very
active user is spread over many partitions by day; the second level groups
the (small) user-day rows by user.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_date, in_range, prune_days, ts_lit


def range_logs(logs: DataFrame, start, end) -> DataFrame:
    return prune_days(logs, start, end).where(in_range(F.col("logged_at"), start, end))


def user_day_rollup(logs: DataFrame, start, end) -> DataFrame:
    """(user_id, date) → day points, productive / unproductive minutes."""
    p, d = F.col("points"), F.col("duration")
    return (range_logs(logs, start, end)
            .groupBy("user_id", F.to_date("logged_at").alias("date"))
            .agg(F.sum(p).alias("day_points"),
                 F.sum(F.when(p > 0, d).otherwise(0)).alias("productive"),
                 F.sum(F.when(p < 0, d).otherwise(0)).alias("unproductive")))


def points_total_avg(rollup: DataFrame, users: DataFrame) -> DataFrame:
    """Total points and the mean over days that have logs, 0 without
    logs. ``round`` is half away from zero, as PostgreSQL numeric."""
    per_user = rollup.groupBy("user_id").agg(
        F.sum("day_points").alias("t"), F.avg(F.col("day_points").cast("double")).alias("a"))
    return (users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left")
            .select("user_id",
                    F.coalesce("t", F.lit(0)).cast("bigint").alias("total_points"),
                    F.round(F.coalesce("a", F.lit(0.0)), 2).alias("average_points_per_day")))


def best_day(rollup: DataFrame) -> DataFrame:
    """R2: the day with the most points; ties go to the earliest date."""
    best = F.min_by(F.struct("date", "day_points"),
                    F.struct((-F.col("day_points")).alias("k"), F.col("date")))
    return (rollup.groupBy("user_id").agg(best.alias("b"))
            .select("user_id", F.col("b.date").alias("date"),
                    F.col("b.day_points").cast("bigint").alias("total_points")))


def productivity_days(rollup: DataFrame, goals: DataFrame, start, end) -> DataFrame:
    """Date × goal status ('no goal' without one) × points.

    The reference joins each log to every goal created that day, so a day
    with n goals of one status counts its points n times. Same result
    without the row fan-out: day points × goal count per (day, status)."""
    d0 = as_date(start)
    d1 = as_date(end) + dt.timedelta(days=1)
    g = (goals.where((F.col("created_at") >= ts_lit(d0)) & (F.col("created_at") < ts_lit(d1)))
         .groupBy("user_id", F.to_date("created_at").alias("date"), "status")
         .agg(F.count(F.lit(1)).alias("n_goals")))
    j = rollup.select("user_id", "date", "day_points").join(g, ["user_id", "date"], "left")
    return j.select("user_id", "date",
                    F.coalesce("status", F.lit("no goal")).alias("status"),
                    (F.col("day_points") * F.coalesce("n_goals", F.lit(1))).cast("bigint").alias("total_points"))


def time_split(rollup: DataFrame, users: DataFrame) -> DataFrame:
    """Productive / unproductive minutes in range; NULL without logs
    (the reference applies no COALESCE here)."""
    per_user = rollup.groupBy("user_id").agg(
        F.sum("productive").cast("bigint").alias("productive_time"),
        F.sum("unproductive").cast("bigint").alias("unproductive_time"))
    return users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left")


def productivity_report(logs: DataFrame, goals: DataFrame, users: DataFrame, start, end) -> DataFrame:
    """R5 (flagship): R1–R4 nested per user, users without logs get an
    empty day list.

    Three shuffles: the user-day rollup of the logs, the goals' statuses per
    (user, day) — co-partitioned with the rollup, so their join moves no
    data — and one per-user aggregate that computes the totals, the best
    day, the time split and the day list together. Each day row expands to
    its (status, points × goals of that status) entries inside the row, as
    R3 does, without fanning rows out."""
    r = user_day_rollup(logs, start, end)
    d0, d1 = as_date(start), as_date(end) + dt.timedelta(days=1)
    g = (goals.where((F.col("created_at") >= ts_lit(d0)) & (F.col("created_at") < ts_lit(d1)))
         .groupBy("user_id", F.to_date("created_at").alias("date"))
         .agg(F.collect_list("status").alias("sts")))
    j = r.join(g, ["user_id", "date"], "left")
    entry_t = "array<struct<date:date,status:string,total_points:bigint>>"
    pts = F.col("day_points").cast("bigint")
    entries = F.when(F.col("sts").isNull(), F.array(F.struct(
        F.col("date"), F.lit("no goal").alias("status"), pts.alias("total_points"))).cast(entry_t)).otherwise(
        F.transform(F.array_distinct("sts"), lambda st: F.struct(
            F.col("date").alias("date"), st.alias("status"),
            (pts * F.size(F.filter("sts", lambda x: x == st))).alias("total_points"))).cast(entry_t))
    per_user = j.groupBy("user_id").agg(
        F.sum("day_points").cast("bigint").alias("total_points"),
        F.round(F.avg(F.col("day_points").cast("double")), 2).alias("average_points_per_day"),
        F.min_by(F.struct("date", pts.alias("total_points")),
                 F.struct((-F.col("day_points")).alias("k"), F.col("date"))).alias("best_productivity_day"),
        F.sum("productive").cast("bigint").alias("productive_time"),
        F.sum("unproductive").cast("bigint").alias("unproductive_time"),
        F.array_sort(F.flatten(F.collect_list(entries))).alias("productivity_days"))
    out = users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left")
    return out.select(
        "user_id",
        F.struct(F.coalesce("total_points", F.lit(0)).cast("bigint").alias("total_points"),
                 F.coalesce("average_points_per_day", F.lit(0.0)).alias("average_points_per_day"))
        .alias("productivity_points"),
        F.col("best_productivity_day"),
        F.coalesce("productivity_days", F.array().cast(entry_t)).alias("productivity_days"),
        F.struct("productive_time", "unproductive_time").alias("time"))


def flat_report(report: DataFrame) -> DataFrame:
    """R5 as flat columns (for tabular sinks and the SQL oracle)."""
    return report.select(
        "user_id",
        F.col("productivity_points.total_points").alias("total_points"),
        F.col("productivity_points.average_points_per_day").alias("average_points_per_day"),
        F.col("best_productivity_day.date").alias("best_date"),
        F.col("best_productivity_day.total_points").alias("best_points"),
        F.size("productivity_days").alias("n_days"),
        F.aggregate("productivity_days", F.lit(0).cast("bigint"),
                    lambda acc, x: acc + x["total_points"]).alias("days_points"),
        F.col("time.productive_time").alias("productive_time"),
        F.col("time.unproductive_time").alias("unproductive_time"))
