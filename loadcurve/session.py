"""Spark session settings the library relies on.

* session time zone ``UTC``: all wall-clock times are ``TIMESTAMP_NTZ`` and
  must never be shifted by a zone (daylight-saving days included);
* ANSI mode on (Spark default) -- the operators use ``try_*`` forms where the
  reference tolerated bad values;
* adaptive query execution on, with skew-join splitting, so hot keys found at
  run time are split instead of landing in one task.

``spark.checkpoint.dir`` is read from the session.  Only a local session
without one (tests, a laptop) gets a private folder; a cluster must name a
shared folder there.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
SPARK_BATCH_BYTES = "67108864b"  # the setting's default

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Starting points for a large cluster (tens of TB): many initial shuffle partitions
# that AQE coalesces to ~256 MB each, 512 MB scan splits, skew splitting on.
CLUSTER_SETTINGS = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def apply_cluster_settings(spark: SparkSession, overrides: dict | None = None) -> SparkSession:
    """Set the cluster starting points that the session does not set explicitly."""
    explicit = spark.conf.getAll
    explicit = explicit() if callable(explicit) else explicit
    for k, v in CLUSTER_SETTINGS.items():
        if k not in explicit:
            spark.conf.set(k, v)
    for k, v in (overrides or {}).items():
        spark.conf.set(k, v)
    return ensure_defaults(spark)


def build_session(master: str = "local[8]", app: str = "loadcurve",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Session for tests and the benchmark (local mode, no UI)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in {**SESSION_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_defaults(spark)


def ensure_defaults(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator assumes to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError(
                f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="loadcurve-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if path.startswith("file:"):
        path = path[len("file:"):]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut the lineage of a small intermediate that several branches read.

    A reliable ``checkpoint()`` in the shared folder: the upstream plan (say, a
    scan of the raw sessions feeding an hourly series) runs once instead of once
    per branch, and a lost executor re-reads the copy.  The copy goes with its
    last reader where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Hand rows to Python tasks in Arrow batches of about ``most`` bytes, unless the session has set its own size.

    Spark's default is 10,000 rows or 64 MB, and a task holds a batch several
    times on both sides of the pipe.  With whole texts that is what a task's
    memory outside the heap follows.
    """
    if spark.conf.get(BATCH_CONF) == SPARK_BATCH_BYTES:
        spark.conf.set(BATCH_CONF, f"{most}b")


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "loadcurve", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the application's folder in the checkpoint folder (one per call)."""
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has written by :func:`scratch_path`; frames that read from it are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
