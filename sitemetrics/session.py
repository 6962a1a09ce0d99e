"""Session settings and the shared folder for checkpoints and written snapshots."""

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# A side may be broadcast only when it is known to hold at most this many (narrow) rows.
MAX_BROADCAST_ROWS = 50_000

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
HEAP_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def build_session(app: str = "sitemetrics", cores: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    cores = cores or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python call site of every Column call costs more than planning for wide reports.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the library relies on; safe to call on a session it did not build."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    local = spark.sparkContext.master.startswith("local")
    if not local and spark.conf.get(STATE_STORE, HEAP_STORE) == HEAP_STORE:
        # Large keyed state (event ids within the delay) belongs in RocksDB, not on the heap.
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if local and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # 200 is the cluster default; each streaming state store costs files per partition on a laptop.
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: spark.checkpoint.dir, or a fresh local one where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext.getCheckpointDir()
    if configured and not known:
        spark.sparkContext.setCheckpointDir(configured)
    if configured or known:
        return configured or known
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sitemetrics-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep on reliable storage, so that several readers share one evaluation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
