"""Sources, triggers and the checkpointed append sink shared by all streaming jobs.

Results that change over time are read as a fold over an append-only sink. This keeps every job exactly-once
on plain files, without a callback from the JVM into the driver.
"""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sitemetrics.session import shared_dir

# Bounds a micro-batch, and with it the rows one key can bring to one task.
MAX_BYTES_PER_TRIGGER = 1 << 30


def event_source(spark: SparkSession, folder: str, schema: StructType | str,
                 max_files: int | None = None) -> DataFrame:
    """Stream of Parquet files in order of their modification time; `folder` may be a glob."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", MAX_BYTES_PER_TRIGGER)
    return reader.parquet(folder)


def trigger_options(every: timedelta | None) -> dict:
    """Detector cadence: a fixed interval, or one drain of what is available."""
    if every is None:
        return {"availableNow": True}
    if every <= timedelta(0):
        raise ValueError("the interval must be positive")
    return {"processingTime": f"{int(every.total_seconds())} seconds"}


def start(stream: DataFrame, sink: str, checkpoint: str, partition_by: str | None = None,
          every: timedelta | None = None, name: str | None = None):
    """Start an append query into `sink`; progress and state live in `checkpoint`."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**trigger_options(every)).start(sink)


def drain(stream: DataFrame, sink: str, checkpoint: str, partition_by: str | None = None) -> DataFrame:
    """Process everything available, then read the sink."""
    query = start(stream, sink, checkpoint, partition_by)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def fresh_run(spark: SparkSession, name: str) -> tuple[str, str]:
    """(sink, checkpoint) of a new run in the shared folder."""
    root = f"{shared_dir(spark)}/streams/{name}-{uuid4().hex}"
    return f"{root}/sink", f"{root}/checkpoint"
