"""Streams fed in several micro-batches give what the batch operators give on the same rows."""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sitemetrics.plans.registry import fixture
from sitemetrics.streaming import jobs, runner

FOLDER = "/root/testdata/sf0.001"
SLICES = 4


@pytest.fixture(scope="module")
def fx(spark):
    return fixture(spark, FOLDER)


@pytest.fixture(scope="module")
def sliced(spark, fx, tmp_path_factory):
    """The event table cut into time-ordered files with increasing modification times."""
    folder = str(tmp_path_factory.mktemp("events"))
    fx.raw("events").repartitionByRange(SLICES, "ts").sortWithinPartitions("ts").write.mode("append").parquet(folder)
    files = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
    assert len(files) == SLICES
    for i, name in enumerate(files):
        os.utime(f"{folder}/{name}", (1_700_000_000 + i * 60, 1_700_000_000 + i * 60))
    return folder


def run(spark, stream, name):
    sink, checkpoint = runner.fresh_run(spark, name)
    query = runner.start(stream, sink, checkpoint)
    query.awaitTermination()
    batches = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    return spark.read.schema(stream.schema).parquet(sink), len(set(batches))


def test_duplicates_across_batches_are_dropped(spark, fx, sliced, tmp_path):
    """The newest file is delivered twice, the second time in a later micro-batch."""
    folder = str(tmp_path)
    files = sorted(f for f in os.listdir(sliced) if f.endswith(".parquet"))
    for i, name in enumerate([*files, files[-1]]):
        with open(f"{sliced}/{name}", "rb") as src, open(f"{folder}/{i}.parquet", "wb") as dst:
            dst.write(src.read())
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i * 60, 1_700_000_000 + i * 60))
    events = fx.event_stream(folder, 1).filter(F.col("kind") == "payment")
    # The repeated file spans about a week, so the delay must cover it.
    got, batches = run(spark, jobs.deduplicated(events, "30 days"), "dedup")
    assert batches == SLICES + 1
    assert sorted(r.event_id for r in got.collect()) == sorted(str(r.payment_id) for r in fx.live_payments.collect())


def test_restart_continues_from_the_checkpoint(spark, fx, sliced):
    sink, checkpoint = runner.fresh_run(spark, "restart")
    stream = jobs.anomaly_stream(fx.event_stream(sliced, 1))
    for _ in range(2):
        rows = runner.drain(stream, sink, checkpoint)
    log = jobs.anomaly_lists(rows)
    assert rows.count() == rows.distinct().count()
    assert log.count() == fx.anomalies.count()


def test_triggers():
    assert runner.trigger_options(None) == {"availableNow": True}
    assert runner.trigger_options(timedelta(seconds=30)) == {"processingTime": "30 seconds"}
    with pytest.raises(ValueError):
        runner.trigger_options(timedelta(0))


def test_interval_trigger_runs(spark, fx):
    sink, checkpoint = runner.fresh_run(spark, "interval")
    query = runner.start(jobs.anomaly_stream(fx.event_stream()), sink, checkpoint, every=timedelta(seconds=30))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(sink).count() > 0
