"""Feature suggestions and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote_tally(suggestions: DataFrame, votes: DataFrame) -> DataFrame:
    """B1: upvote = stored start + Σ delta (±1). No per-voter dedup exists in
    the reference. ``sum`` is partial map-side, so a hot suggestion
    shuffles one row per map task."""
    d = votes.groupBy(F.col("suggestion_id").alias("id")).agg(F.sum("delta").alias("_d"))
    return (suggestions.join(d, "id", "left")
            .select("id", "title", (F.col("upvote") + F.coalesce("_d", F.lit(0))).cast("int").alias("upvote")))


def suggestion_ranking(tally: DataFrame, suggestions: DataFrame, limit: int | None = None) -> DataFrame:
    """B2: suggestions by upvote, best first (id breaks ties). Without a
    limit this is a range-partitioned global sort; ``pos`` is only given
    with a limit: the window numbers the rows of the top-n only."""
    s = suggestions.drop("upvote").join(tally.select("id", "upvote"), "id")
    order = [F.col("upvote").desc(), F.col("id")]
    if limit is None:
        return s.select("id", "title", "description", "user_id", "upvote").orderBy(*order)
    w = Window.orderBy(*order)
    return (s.orderBy(*order).limit(limit).withColumn("pos", F.row_number().over(w))
            .select("pos", "id", "title", "description", "user_id", "upvote"))


def add_suggestions(requests: DataFrame, users: DataFrame) -> DataFrame:
    """New suggestions with the author's username, upvote 0."""
    return (requests.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
            .select("id", "title", "description", "username", F.lit(0).alias("upvote")))
