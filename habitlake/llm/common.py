"""Shared steps of the training-data operators: reading, storing, passes over texts, sampling hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import configure, ensure_checkpoint_dir

#: Java class of white space between words
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as parquet under the shared checkpoint folder and read back: cuts lineage, survives
    lost executors. Empty tables keep their schema."""
    spark = configure(df.sparkSession)
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed(col):
    """The same values; being nondeterministic to the optimizer, the expression is not copied into later filters, where
    its parts would be evaluated anew for each element that a lambda looks at."""
    return F.when(F.monotonically_increasing_id() >= 0, col)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def annotate(df: DataFrame, text: str, added: T.StructType, make: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """``df`` with columns computed from the string column ``text``, in one pass without a shuffle.

    ``make()`` runs once per task and gives a function from an Arrow string array to one Arrow array per added column.
    """
    schema = T.StructType(df.schema.fields + added.fields)
    names, at = schema.names, df.columns.index(text)
    kinds = [f.type for f in to_arrow_schema(added)]

    def run(batches):
        fn = make()
        for b in batches:
            if b.num_rows:
                new = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(fn(b.column(at)), kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=names)

    return df.mapInArrow(run, schema)


def rows_with(docs: DataFrame, added: T.StructType, make) -> DataFrame:
    """``annotate`` over whole rows whatever their columns are called: ``_row`` holds the original row, beside the
    added columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    return annotate(packed, "_text", added, make).drop("_text")


def rows_by_range(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the place (from 0) of each row in the order, by ranges: no task sorts or numbers all rows."""
    n = tasks(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    ranged = stored(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "ranges")
    sizes = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}  # one row per task
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("_p", "_i")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_p"))
    return ranged.withColumn(name, (base + F.col("_i") - 1).cast("long")).drop("_p", "_i")
