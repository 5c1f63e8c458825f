"""Session helpers.

Library code never creates a session of its own: every operator takes the
tables as DataFrames. These helpers exist for tests, ``bench.py`` and small
scripts, and for finding the shared folder used to cut lineage.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings the operators are designed around, for a cluster session (pass them
# to the builder or spark-submit). Shuffle partitions start high and AQE
# coalesces them to ~advisory size; skewed join partitions are split.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 256 * 1024**2, floor: int = 200) -> int:
    """Initial shuffle partitions so each holds about ``target_bytes`` of input
    (AQE coalesces small ones at run time)."""
    return max(floor, -(-input_bytes // target_bytes))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "seatledger") -> SparkSession:
    """A local session configured like the cluster one (AQE, skew join, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SEATLEDGER_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables and checkpoints.

    In this order: the folder already set on the Spark context, the folder
    named by ``spark.checkpoint.dir``, and, with a local master only, a fresh
    scratch folder (set on the context, so that it is made once a session).
    Any other master without a folder is an error: executors there do not
    share the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        # the context appends an id of its own to the folder it is given
        return current
    current = spark.conf.get(CHECKPOINT_KEY, None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="seatledger-ckpt-")
    sc.setCheckpointDir(current)
    return current
