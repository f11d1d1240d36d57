"""Session defaults for running the models, and the shared scratch location."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A shuffled join whose dimension parts turn out small is hashed and need not sort the fact.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Reliable checkpoints are deleted once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Dynamic mode lets a merge rewrite only the days it touches.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Keyed streaming state lives off-heap and on disk, not in the executor's heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str = "tunelake", **extra: str) -> SparkSession:
    """A session with the defaults above; the cluster's own settings (master, memory, shuffle
    partitions, checkpoint folder) come from spark-submit or from ``extra``."""
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def default_root(master: str, default_fs: str) -> str:
    """Where intermediate data goes if ``spark.checkpoint.dir`` is unset: a folder of the cluster's
    default file system, which has to be shared unless everything runs in one process."""
    scheme = default_fs.split(":")[0] if ":" in default_fs else "file"
    if scheme == "file" and not master.startswith("local[") and master != "local":
        raise ValueError(
            f"spark.checkpoint.dir is unset and the default file system ({default_fs}) is local to "
            f"each machine of {master}; set spark.checkpoint.dir to a shared folder"
        )
    return f"{default_fs.rstrip('/') or 'file:'}/tmp/checkpoints/tunelake-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only if it is unset."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        hadoop = context._jsc.hadoopConfiguration()
        root = default_root(context.master, hadoop.get("fs.defaultFS") or "file:///")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
