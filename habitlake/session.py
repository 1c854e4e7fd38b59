"""Spark session helpers.

Cluster settings (shuffle partitions, checkpoint dir, memory) come from the
deployment; only values that are unset get a local default here, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC event times, AQE for runtime
# re-planning (coalescing, skew-join splitting, broadcast switch), and
# Arrow batches bounded by bytes: 10,000 rows of long texts take tens of MB,
# several times over, in the executor and in each Python worker.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

_shipped: set[str] = set()


def get_session(master: str = "local[8]", app: str = "habitlake",
                shuffle_partitions: int = 8, extra_conf: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, no server)."""
    os.environ.setdefault("PYTHONWARNINGS", "ignore::FutureWarning")  # pandas noise in Python workers
    b = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        b = b.config(k, v)
    spark = (
        b.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: the stream processors and Arrow functions are
    pickled by reference, and only the driver's path has the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="habitlake-code-"), "habitlake-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only a local master (tests, local runs) may leave
    it unset and gets a scratch folder; a cluster must name one, since a
    machine-local folder would not be seen by the other executors."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="habitlake-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
