"""Session settings and lineage cutting.

Nothing here is needed to use the operators, which take and return DataFrames; the helpers make
a session whose settings suit them and find the shared folder that iterative jobs write to.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed while a session runs.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when an aggregate above could have reused its layout.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method above 8000 bytes of bytecode. A stage with wide expressions is
    # faster as separate generated projections, which Spark splits into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # The state of streams grows with the keys and windows of the input: on disk, not in the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "watchmere", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings of this library; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else made."""
    for name, value in RUNTIME_CONF.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names.

    Only a local session, which has no other machine to share with, may fall back to a folder of
    its own; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="watchmere-checkpoints-")
    context.setCheckpointDir(root)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back, so that its history is forgotten."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder, for tables that a job writes and reads again."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


# Rows for which a task of its own is worth its start.
ROWS_PER_TASK = 4096


def spread(df: DataFrame, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """`df`, which has `rows` rows, dealt evenly to as many tasks as run at once, or fewer if there are few rows.

    Iterative jobs take their tasks from their input, which one file gives to a single one and many files to more than
    run at once; what tasks send each other in every round grows with their number.
    """
    at_once = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(at_once, math.ceil(rows / per_task))))
