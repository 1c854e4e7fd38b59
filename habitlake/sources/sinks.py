"""S2 / S4 — sinks: partitioned append of logs, nested JSON responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_logs(df: DataFrame, path: str, batch_id: str) -> None:
    """Append a batch of logs to the event table, partitioned by log date
    (so day queries prune files) and by batch.

    Idempotent: a batch owns its partitions and replaces just these
    (dynamic partition overwrite), so writing it again, after a lost writer
    too, leaves one copy and touches no other batch. A batch must hold the
    same rows each time, as its producers' ids do. Rows are clustered by log
    date first (AQE splits a large day over tasks), so a batch adds few files
    a day."""
    (df.withColumn("log_date", F.to_date("logged_at")).withColumn("batch_id", F.lit(batch_id))
     .hint("rebalance", "log_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("log_date", "batch_id").parquet(path))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The event table that :func:`append_logs` writes, without the batch."""
    return spark.read.option("basePath", path).parquet(path).drop("batch_id")


def _api_date(c):
    """A DATE as the API renders it (a Go time at UTC midnight)."""
    return F.date_format(c, "yyyy-MM-dd'T'00:00:00'Z'")


def to_report_json(report: DataFrame) -> DataFrame:
    """R5 rows → the API's JSON document: keys as the reference's
    models, totals as text (PostgreSQL numerics arrive as strings), dates as
    RFC 3339 times, and ``[]`` for a user without logs in the range (the
    reference answers with the empty day list and stops there)."""
    pp = F.struct(F.col("productivity_points.total_points").cast("string").alias("total_points"),
                  F.format_string("%.2f", F.col("productivity_points.average_points_per_day"))
                  .alias("average_points"))
    best = F.struct(_api_date(F.col("best_productivity_day.date")).alias("date"),
                    F.col("best_productivity_day.total_points").alias("total_points"))
    days = F.transform("productivity_days", lambda d: F.struct(
        _api_date(d["date"]).alias("date"), d["total_points"].alias("total_points"), d["status"].alias("status")))
    doc = F.struct(pp.alias("productivity_points"), best.alias("best_productivity_day"),
                   days.alias("productivity_days"), F.col("time").alias("time"))
    js = F.when(F.size("productivity_days") == 0, F.lit("[]")).otherwise(
        F.to_json(doc, {"ignoreNullFields": "false"}))
    return report.select("user_id", js.alias("json"))


def _activity_json(m):
    return F.struct(m["activity_id"].alias("activity_id"), m["name"].alias("name"),
                    m["points"].alias("points"), m["activity_type"].alias("type"))


def to_log_responses(classified: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Per text, the response of the text-logging endpoint: the
    single-activity form, or ``{"activity_logs": [...]}`` when the text
    named several activities. Zero-valued ``omitzero`` fields are left
    out; ``matched_activities`` is always present (null when empty)."""
    if "description" in classified.columns:
        c = classified
    else:
        c = classified.join(texts.select("id", F.col("text").alias("description")), "id")
    matched = F.when(F.size("matched") > 0, F.to_json(F.transform("matched", _activity_json))).otherwise(F.lit("null"))
    rest = F.to_json(F.struct(
        F.when(F.col("outcome") != "log", F.nullif(F.col("duration"), F.lit(0))).alias("duration"),
        F.when(F.col("outcome") != "log", F.nullif(F.col("description"), F.lit(""))).alias("description"),
        F.nullif(F.col("name"), F.lit("")).alias("name")), {"ignoreNullFields": "true"})
    one = F.concat(F.lit('{"matched_activities":'), matched,
                   F.when(rest == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(rest, 2, 1 << 30))))
    per = c.select("id", "user_id", "pos", "n_activities", one.alias("j"))
    grouped = per.groupBy("id", "user_id", "n_activities").agg(
        F.array_sort(F.collect_list(F.struct("pos", "j"))).alias("items"))
    multi = F.concat(F.lit('{"activity_logs":['), F.array_join(F.transform("items", lambda x: x["j"]), ","),
                     F.lit("]}"))
    return grouped.select("id", "user_id", F.when(F.col("n_activities") == 1, F.col("items")[0]["j"])
                          .otherwise(multi).alias("json"))
