"""S3 — ingest JSON request records against a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
ID_SHAPE = "^[0-9]+$"  # ids are BIGINT keys here (UUIDs in the reference)


def ingest_requests(df: DataFrame, schema: T.StructType, id_fields=("activity_id",)) -> tuple[DataFrame, DataFrame]:
    """Parse ``df.value`` with ``schema`` (PERMISSIVE, corrupt text kept)
    and split into good rows and quarantined rows with a reason:
    'decode error' (not JSON, empty or NULL) or 'bad id' (an id field that is
    no BIGINT).
    Both frames come from one parse; nothing is re-read."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    parsed = df.withColumn("_r", F.from_json("value", full, {"mode": "PERMISSIVE",
                                                              "columnNameOfCorruptRecord": CORRUPT}))
    keep = [c for c in df.columns if c != "value"]
    flat = parsed.select(*keep, "value", F.col("_r").isNull().alias("_none"), "_r.*")
    bad_id = F.lit(False)
    for f in id_fields:
        bad_id = bad_id | (F.col(f).isNotNull() & (~F.col(f).rlike(ID_SHAPE) | F.col(f).try_cast("bigint").isNull()))
    reason = (F.when(F.col(CORRUPT).isNotNull() | F.col("_none") | (F.trim("value") == ""), F.lit("decode error"))
              .when(bad_id, F.lit("bad id")))
    flat = flat.withColumn("_reason", reason)
    good = flat.where(F.col("_reason").isNull()).select(*keep, *[f.name for f in schema.fields])
    bad = flat.where(F.col("_reason").isNotNull()).select(*keep, "value", F.col("_reason").alias("reason"))
    return good, bad
