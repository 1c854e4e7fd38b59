"""Window helpers that stay safe when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, part: list[str], order: list[Column | str], value: str, out: str,
                chunk: Column | None = None) -> DataFrame:
    """``sum(value) OVER (PARTITION BY part ORDER BY order ROWS UNBOUNDED
    PRECEDING)`` without sending a whole partition to one task.

    ``chunk`` must be monotone in ``order`` (e.g. the minute of a
    timestamp that leads the order). Each (part, chunk) group is summed
    on its own; an exclusive prefix over the chunk totals — at most one
    row per chunk — gives each chunk's offset; the row's value is its
    offset plus its running sum inside the chunk. A hot key is thus
    spread over as many tasks as it has chunks.
    """
    if chunk is None:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    c = df.withColumn("_chunk", chunk)
    totals = c.groupBy(*part, "_chunk").agg(F.sum(value).alias("_ct"))
    w_prev = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_chunk", F.coalesce(F.sum("_ct").over(w_prev), F.lit(0)).alias("_off"))
    w_in = (Window.partitionBy(*part, "_chunk").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0))
    inner = c.withColumn("_in", F.sum(value).over(w_in))
    return (inner.join(offsets, [*part, "_chunk"])
            .withColumn(out, (F.col("_off") + F.col("_in")).cast("bigint"))
            .drop("_chunk", "_off", "_in"))
