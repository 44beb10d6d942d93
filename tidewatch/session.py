"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Compressed bytes that a task after a shuffle takes, and the parts that a shuffle is written in for each one that the
# session asks for; adaptive execution joins small ones. A chain of windows holds some fifty times these bytes over its sorts.
TASK_BYTES, FINER = "8m", 4
# Input rows for each part that a shuffle is written in: adaptive execution joins parts but cuts none, so their number
# has to follow the input.
PART_ROWS = 25_000
# Spark's own setting that drops a query's shuffle files when it ends, not when the driver collects its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The setting that names the parts a shuffle is written in.
PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Paths of pinned tables that go when the block they were written in ends.
_PINS: ContextVar[list[str] | None] = ContextVar("pins", default=None)


def build_session(app: str = "tidewatch", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `cores` asks for a local master."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = (builder.master(f"local[{cores}]")
                   .config("spark.driver.memory", os.environ.get("TIDEWATCH_MEMORY", "16g"))
                   .config("spark.ui.enabled", "false")
                   .config("spark.sql.shuffle.partitions", str(cores))
                   .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
                   # Small local inputs should still use every core.
                   .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k"))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Long generated methods are common in wide window chains; let the JVM compile them.
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        # Stream state on disk, with checkpoints of what changed: joins may hold months of decisions.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # Recording a call site per expression takes longer than building these plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return sized(builder.getOrCreate())


def shuffle_parts(spark: SparkSession) -> int:
    """Parts that a shuffle is written in; `sized` makes them follow the rows."""
    return int(spark.conf.get(PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def sized(spark: SparkSession, rows: int = 0) -> SparkSession:
    """The session with shuffle tasks of bounded size for inputs of up to `rows` rows: more rows make more tasks, not larger ones."""
    parts = max(FINER * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    spark.conf.set(PARTS, str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    # Rows and tables that are placed by an entity are joined on entity and time where they are.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a private one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            current = tempfile.mkdtemp(prefix="tidewatch-")
        context.setCheckpointDir(current)
        current = context.getCheckpointDir()
    return current


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries that are written inside drop their shuffle files when they end."""
    before = spark.conf.get(FREE)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


@contextmanager
def pins_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables pinned inside are deleted when the block ends: nothing may read them later."""
    token = _PINS.set([])
    try:
        yield
    finally:
        paths = _PINS.get()
        _PINS.reset(token)
        for path in paths:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def pinned(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder as Parquet, so every later read sees the same rows."""
    spark = df.sparkSession
    path = scratch(spark, "pinned")
    if _PINS.get() is not None:
        _PINS.get().append(path)
    with freeing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
