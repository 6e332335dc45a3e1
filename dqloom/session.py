"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  Everything else (memory, executors, shuffle
# partition count, broadcast threshold) is left to the cluster's own defaults.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# What a task takes at once: a compressed MB of keys is up to 20 MB of sorted rows and hash tables, and a plan of a
# few dozen branches keeps several of them in a task.  Spark's own 64 and 128 MB are set for plans of one.
TASK_SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.files.maxPartitionBytes": "16m",
}

LOCAL = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


def local_session(app: str = "dqloom", cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**DEFAULTS, **TASK_SIZES, **LOCAL, **conf}.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()


def with_task_sizes(spark: SparkSession) -> SparkSession:
    """The session with ``TASK_SIZES``, where its owner has set no sizes; memory then stays the same as tables grow."""
    for key, value in TASK_SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session may fall back to a temporary one."""
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="dqloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once so that later readers do not recompute it.

    Used where several jobs read one expensive frame: unlike a cache, the copy
    survives the loss of the executors that wrote it.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
