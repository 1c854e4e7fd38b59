"""Run helpers for the streaming operators.

Sources are file streams (parquet, fixed schema); sinks are parquet tables
written from ``foreachBatch`` into one folder per batch id, so a replayed
batch overwrites its own output (exactly-once together with the
checkpoint). All folders live under the cluster's shared checkpoint
location, never on a machine-local disk.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return os.path.join(ensure_checkpoint_dir(spark), "habitlake-stream", f"{what}-{uuid.uuid4().hex}")


def stage_in_event_order(df: DataFrame, ts_col: str, path: str, rows_per_file: int = 1_000_000,
                         min_files: int = 4) -> str:
    """Replay helper: one distributed write of ``df`` into ``path``, in ranges
    of event time of about equal row counts, one file each, so a file stream
    reads them in event order. Rows of one instant may part. A file source
    orders files by modification time, so the files' times are set in the
    order of the ranges, after those staged before. Only a row count and the
    list of files come to the driver. A ``df`` that is costly to compute should
    be stored first (:func:`stored`): counting, ranging and writing each run it."""
    spark = df.sparkSession
    n_files = max(min_files, -(-df.count() // rows_per_file))
    batch = f"{path}/staged-{uuid.uuid4().hex}"
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])  # parts rows of one instant
    df.repartitionByRange(n_files, F.col(ts_col), spread).write.parquet(batch)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = [f.getModificationTime() for f in _files(fs, root) if not f.getPath().toString().startswith(batch)]
    start = max([*taken, 0]) + 1000 if taken else 1_000_000_000_000
    for i, f in enumerate(sorted(_files(fs, jvm.org.apache.hadoop.fs.Path(batch)), key=lambda f: f.getPath().getName())):
        target = jvm.org.apache.hadoop.fs.Path(path, f"{batch.rsplit('/', 1)[1]}-{i:06d}.parquet")
        fs.rename(f.getPath(), target)
        fs.setTimes(target, start + 1000 * i, -1)
    fs.delete(jvm.org.apache.hadoop.fs.Path(batch), True)
    return path


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(fs, path) -> list:
    """Data files under a folder."""
    found, it = [], fs.listFiles(path, True)
    while it.hasNext():
        f = it.next()
        if f.getPath().getName().endswith(".parquet"):
            found.append(f)
    return found


def files_per_batch(spark: SparkSession, path: str, batches: int = 16) -> int:
    """How many of the staged files a micro-batch of a replay takes, for at most ``batches`` of them: the state that a
    replay carries from batch to batch is then read and written as often however long the table is."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return -(-len(_files(root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root)) // batches)


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


#: provider of the state of the stream processors
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available_now(stream: DataFrame, mode: str, out_path: str, ckpt_path: str,
                      batch_fn=None) -> dict:
    """Drive ``stream`` to the end of its input (AvailableNow trigger) and
    write each micro-batch to ``out_path/batch_id=<n>``. Returns the last
    progress (rows dropped by the watermark are reported there)."""

    def write(batch: DataFrame, batch_id: int):
        b = batch_fn(batch, batch_id) if batch_fn else batch
        b.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt_path)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    progress = q.recentProgress
    return {"progress": progress, "dropped": sum(
        op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators", []))}


def latest_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Current state from update-mode outputs: the row of the highest
    batch id per key (a partial ``max_by`` aggregate)."""
    vals = [c for c in df.columns if c not in keys and c != "batch_id"]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in vals]))
