"""Session settings shared by the library, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on.  AQE re-plans joins from measured sizes,
# splits skewed shuffle partitions and coalesces small ones; UTC keeps date
# arithmetic identical to the DuckDB oracle.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "fieldlab", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read here.
    When it is unset in a local run a private folder is created and set, so
    ``DataFrame.checkpoint()`` works the same way everywhere; on a cluster an
    unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="fieldlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scale_settings(input_bytes: int, total_cores: int, split_bytes: int = 512 << 20,
                   shuffle_bytes_per_task: int = 256 << 20, shuffle_fraction: float = 0.25) -> dict:
    """Starting settings for a cluster run over ``input_bytes`` of results.

    Scan splits of ``split_bytes``; initial shuffle parallelism sized so
    each task gets about ``shuffle_bytes_per_task`` of shuffled data,
    assuming the queries shuffle ``shuffle_fraction`` of the input (they
    project few columns and pre-aggregate); AQE then merges small partitions
    and splits skewed ones.  Never below two tasks per core."""
    shuffle = max(2 * total_cores, int(input_bytes * shuffle_fraction // shuffle_bytes_per_task) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(shuffle_bytes_per_task),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * shuffle_bytes_per_task),
    }
