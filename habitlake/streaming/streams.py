"""Structured Streaming twins of the write path.

The reference reacts to each insert (re-reading the day's totals) and pushes
websocket notices. Here the same results come from streaming queries with
watermarks; each has a batch twin in ``operators`` that it must equal
when the input arrives in event order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVITE_MESSAGE = "Invite received"  # fixed value: the reference's websocket notice


def event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; event times are stored zone-less (NTZ) and
    read as UTC, so the cast keeps the instant."""
    return df.withColumn("et", F.col(col).cast("timestamp"))


def daily_rollup_stream(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """L1: per user and (tumbling) day: points, minutes, productive /
    unproductive minutes and log count. Update mode; rows later than the
    watermark are dropped (and counted in the query progress)."""
    p, d = F.col("points"), F.col("duration")
    return (event_time(logs, "logged_at").withWatermark("et", late)
            .groupBy("user_id", F.window("et", "1 day").alias("w"))
            .agg(F.sum(p).alias("total_points"), F.sum(d).alias("total_minutes"),
                 F.sum(F.when(p > 0, d).otherwise(0)).alias("productive_time"),
                 F.sum(F.when(p < 0, d).otherwise(0)).alias("unproductive_time"),
                 F.count(F.lit(1)).alias("n_logs"))
            .select("user_id", F.to_date("w.start").alias("date"), "total_points", "total_minutes",
                    "productive_time", "unproductive_time", "n_logs"))


def vote_stream(votes: DataFrame) -> DataFrame:
    """Running vote sum per suggestion (update mode, one state row per
    suggestion)."""
    return votes.groupBy("suggestion_id").agg(F.sum("delta").alias("votes"))


def invite_notify_stream(invitations: DataFrame, connected: DataFrame, late: str = "1 day") -> DataFrame:
    """One 'Invite received' notice per new invitation whose recipient
    is connected (stream ⋈ static); a re-delivered invitation id within the
    watermark is dropped."""
    inv = event_time(invitations, "created_at").withWatermark("et", late).dropDuplicatesWithinWatermark(["id"])
    c = connected.select(F.col("user_id").alias("recipient_id")).distinct()
    return inv.join(c, "recipient_id").select(
        F.col("id").alias("invitation_id"), "recipient_id", "team_id", F.lit(INVITE_MESSAGE).alias("message"))
