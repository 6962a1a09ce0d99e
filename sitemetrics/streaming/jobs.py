"""Streaming operators. Each has a streaming part (append mode) and a reader that folds the sink.

Event streams carry: event_id string, kind (in / out / payment / detected / resolved), site_id, member_id,
event_time TIMESTAMP, delta, amount, plan_type, anomaly fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import timeutil as tu
from sitemetrics.functions.timeutil import DEFAULT_TZ
from sitemetrics.operators import anomalies
from sitemetrics.sources.tables import Tables

DELAY = "2 hours"


def deduplicated(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event_id once, although it may arrive several times within the delay."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


# -------------------------------------------------------------------------------------------- feed

FEED_KINDS = {"in": "checkin", "out": "checkout", "payment": "payment"}


def feed_stream(events: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in FEED_KINDS.items() for x in kv])
    return (events.filter(F.col("kind").isin(*FEED_KINDS))
            .select("site_id", F.col("event_id").alias("id"), kinds[F.col("kind")].alias("event_type"), "member_id",
                    "event_time", "amount", "plan_type"))


# ----------------------------------------------------------------------------------- anomaly lists

def anomaly_stream(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("kind").isin("detected", "resolved"))
            .select("kind", "anomaly_id", "site_id", "anomaly_type", "severity", "message", "event_time"))


def anomaly_lists(arrived: DataFrame) -> DataFrame:
    """The log after folding all events: detections listed, resolutions merged by id. Idempotent."""
    at = F.col("event_time").cast("timestamp_ntz")
    found = arrived.filter(F.col("kind") == "detected").dropDuplicates(["anomaly_id"]).select(
        "anomaly_id", "site_id", F.col("anomaly_type").alias("type"), "severity", "message",
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(False).alias("resolved"))
    done = arrived.filter(F.col("kind") == "resolved").select(
        "anomaly_id", "site_id", F.col("anomaly_type").alias("type"), "severity", "message", at.alias("resolved_at"))
    return anomalies.merge_resolved(found, done)


# -------------------------------------------------------------------------------------- enrichment

def enriched(events: DataFrame, t: Tables) -> DataFrame:
    """Visit events with member name and site capacity from the static tables."""
    return (events.filter(F.col("kind").isin("in", "out"))
            .join(t.site_bounded(t.sites.select("site_id", "capacity")), "site_id")
            .join(t.members.select("member_id", F.col("name").alias("member_name")), "member_id")
            .select("event_id", "kind", "site_id", "member_id", "member_name", "capacity", "event_time"))


def visits_to_append(events: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """New visits and payments for the date-partitioned append sink."""
    return (events.filter(F.col("kind").isin("in", "payment"))
            .select("event_id", "kind", "site_id", "member_id", "event_time", "amount", "plan_type",
                    tu.local_date(F.col("event_time").cast("timestamp_ntz"), tz).alias("local_date")))
