"""V1–V5: team invitations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import running_sum
from .teams import membership_id


def inbox(invitations: DataFrame, teams: DataFrame) -> DataFrame:
    """V1: invitations per recipient with team info; ``pos`` = newest first.

    ``pos`` is a running count in (created_at desc, id desc) order, computed
    in day chunks (newest day first) so a recipient with a huge inbox is
    spread over many tasks instead of one sorted partition."""
    t = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"), "team_industry", "team_size")
    j = invitations.join(t, "team_id").withColumn("_one", F.lit(1))
    ranked = running_sum(j, ["recipient_id"], [F.col("created_at").desc(), F.col("id").desc()], "_one", "_pos",
                         chunk=-F.unix_date(F.to_date("created_at")))
    return ranked.select("recipient_id", F.col("id").alias("invitation_id"), "team_id", "team_name",
                         "team_industry", "team_size", F.col("_pos").cast("int").alias("pos"))


def unread_counts(invitations: DataFrame, users: DataFrame) -> DataFrame:
    """V2: unseen invitations per user (0 when none)."""
    c = (invitations.where(~F.col("seen")).groupBy("recipient_id")
         .agg(F.count("recipient_id").alias("invite_count")))
    return (users.select(F.col("id").alias("recipient_id")).join(c, "recipient_id", "left")
            .select("recipient_id", F.coalesce("invite_count", F.lit(0)).cast("bigint").alias("invite_count")))


def mark_seen(invitations: DataFrame, recipients: DataFrame) -> DataFrame:
    """V3: set seen = true on the unseen invitations of the given recipients."""
    r = recipients.select(F.col("user_id").alias("recipient_id")).distinct().withColumn("_hit", F.lit(True))
    j = invitations.join(r, "recipient_id", "left")
    return j.select(*[F.col(c) if c != "seen" else (F.col("seen") | F.coalesce("_hit", F.lit(False))).alias("seen")
                      for c in invitations.columns])


def apply_responses(invitations: DataFrame, memberships: DataFrame,
                    responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V4: 'accept' adds a (team, user) membership unless one exists (the
    reference ignores that insert error); both answers delete the
    invitation. Ids are text, as new ones are hashes of (team, user)."""
    done = responses.select(F.col("invitation_id").alias("id")).distinct()
    remaining = invitations.join(done, "id", "left_anti")
    acc = (responses.where(F.col("response") == "accept").select("team_id", "user_id").distinct()
           .join(memberships.select("team_id", "user_id"), ["team_id", "user_id"], "left_anti"))
    new = acc.select(membership_id("team_id", "user_id").alias("id"), "team_id", "user_id")
    return remaining, memberships.select(F.col("id").cast("string").alias("id"), "team_id", "user_id").unionByName(new)


def create_invitations(requests: DataFrame) -> DataFrame:
    """V5: append invitations, status 'pending', unseen; repeats allowed."""
    return requests.select("id", "team_id", "sender_id", "recipient_id", F.lit("pending").alias("status"),
                           "created_at", F.lit(False).alias("seen"))
