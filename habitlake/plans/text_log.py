"""I7 — the text logging path as one DAG: extract → match → classify →
score → daily cap → (append). Existing logs of the same user-days take part
in the cap as already-stored minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import DAILY_MINUTES_CAP, score_points
from ..functions.ids import new_id
from ..operators import ingest as I
from ..sources.sinks import to_log_responses


#: a longer duration counts as this one: over any cap either way
MAX_INT = 2**31 - 1


def text_log_responses(texts: DataFrame, acts: DataFrame, synonyms: DataFrame, max_edits: int = 1) -> DataFrame:
    """S4 for the text path: per text, the response document (no cap needed)."""
    pairs, _ = I.extract_activities(texts.select("id", "user_id", "text", F.col("text").alias("description")))
    return to_log_responses(I.classify_matches(I.match_activities(pairs, acts, synonyms, max_edits)))


def log_from_texts(texts: DataFrame, acts: DataFrame, logs: DataFrame, synonyms: DataFrame,
                      cap: int = DAILY_MINUTES_CAP, max_edits: int = 1) -> dict[str, DataFrame]:
    """``texts``: id, user_id, text, logged_at. Returns the decided
    candidates, of them the accepted new logs and the cap-rejected ones, per-text responses and the texts
    rejected by extraction. Ids of new logs derive from (text id, position);
    at one instant stored logs come before new ones, and those in order of
    text and position."""
    pairs, rejects = I.extract_activities(
        texts.select("id", "user_id", "text", "logged_at", F.col("text").alias("description")))
    cls = I.classify_matches(I.match_activities(pairs, acts, synonyms, max_edits))
    cand = (cls.where(F.col("outcome") == "log")
            .select("id", F.col("id").alias("text_id"), "pos", "user_id",
                    F.col("matched")[0]["activity_id"].alias("activity_id"),
                    F.least(F.col("duration").cast("bigint"), F.lit(MAX_INT)).cast("int").alias("duration"),
                    score_points(F.col("duration"), F.col("matched")[0]["points"]).alias("points"),
                    F.col("description").alias("activity_description"), "logged_at"))
    # only user-days that may receive a candidate need their stored minutes: those of the texts, known without matching
    days = texts.select("user_id", F.to_date("logged_at").alias("_day")).distinct()
    stored = (logs.withColumn("_day", F.to_date("logged_at")).join(days, ["user_id", "_day"], "left_semi")
              .select("id", F.lit(False).alias("is_new"), F.col("id").alias("text_id"),
                      F.lit(0).alias("pos"), "user_id", "logged_at", "duration", F.lit(True).alias("forced"),
                      F.lit(None).cast("bigint").alias("activity_id"), F.lit(None).cast("int").alias("points"),
                      F.lit(None).cast("string").alias("activity_description")))
    keep = ("activity_id", "duration", "points", "activity_description")
    adm = I.daily_cap_admission(
        cand.select("id", F.lit(True).alias("is_new"), "text_id", "pos", "user_id", "logged_at",
                    F.lit(False).alias("forced"), *keep).unionByName(stored),
        cap, keep=(*keep, "text_id", "pos"), order=("is_new", "text_id", "pos"))
    # the new ids, which do not compress, are made behind the shuffle
    decided = adm.where(~F.col("forced")).select(new_id("text_log", "text_id", "pos").alias("id"), "user_id", *keep, "logged_at",
                                                 "accepted", "minutes_after")
    return {
        "decided": decided,
        "accepted": decided.where("accepted").drop("accepted", "minutes_after"),
        "over_cap": decided.where(~F.col("accepted")).drop("accepted"),
        "responses": to_log_responses(cls),
        "rejects": rejects,
    }
