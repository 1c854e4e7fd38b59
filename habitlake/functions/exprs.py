"""Column expressions shared by the operators (all JVM-side, codegen'd)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed parameters of the reference's workload.
DAILY_MINUTES_CAP = 1440          # minutes a user may log per day
RECENT_K = 3                      # recent activities on the dashboard
SEARCH_LIMIT = 10                 # users per search
REMINDER_EVERY_HOURS = 3          # goal reminder period
RESET_TTL_MINUTES = 20            # password reset token lifetime


def as_date(d) -> dt.date:
    return d if isinstance(d, dt.date) and not isinstance(d, dt.datetime) else dt.date.fromisoformat(str(d)[:10])


def ts_lit(t) -> Column:
    """A TIMESTAMP_NTZ literal (event times carry no zone)."""
    if isinstance(t, dt.date) and not isinstance(t, dt.datetime):
        t = dt.datetime(t.year, t.month, t.day)
    if isinstance(t, str):
        t = dt.datetime.fromisoformat(t)
    return F.expr(f"TIMESTAMP_NTZ '{t.isoformat(sep=' ')}'")


def date_lit(d) -> Column:
    return F.expr(f"DATE '{as_date(d).isoformat()}'")


def in_range(c: Column, start, end) -> Column:
    """Half-open ``[start, end)`` on an NTZ timestamp; pushed to the scan."""
    return (c >= ts_lit(start)) & (c < ts_lit(end))


def on_day(c: Column, day) -> Column:
    """``DATE(c) = day`` written as a range so parquet can prune row groups."""
    d = as_date(day)
    return in_range(c, d, d + dt.timedelta(days=1))


def prune_days(df: DataFrame, start, end_exclusive) -> DataFrame:
    """When the frame is a log table partitioned by ``log_date`` (as S2
    writes it), also filter that column so whole partitions are skipped;
    the timestamp range alone only prunes row groups."""
    if "log_date" not in df.columns:
        return df
    d0 = as_date(start)
    e = end_exclusive if isinstance(end_exclusive, dt.datetime) else None
    d1 = as_date(end_exclusive) if e is None or e.time() == dt.time(0) else as_date(end_exclusive) + dt.timedelta(days=1)
    return df.where((F.col("log_date") >= date_lit(d0)) & (F.col("log_date") < date_lit(d1)))


def score_points(duration: Column, rate: Column) -> Column:
    """``round(duration * (rate / 60))`` half away from zero, as int.

    Divide first, then multiply, in double — the float order of the
    reference, so ties land on the same side. Points beyond an int are NULL."""
    return F.round(duration.cast("double") * (rate.cast("double") / F.lit(60.0))).try_cast("int")


def null_split_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` where rows with a NULL key skip
    the shuffle: they can never match, and hashed together they would all
    land in one partition (a skew hot spot at scale)."""
    matched = left.where(F.col(key).isNotNull()).join(right, key, "left")
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key]
    unmatched = left.where(F.col(key).isNull()).select("*", *extra)
    return matched.unionByName(unmatched)

