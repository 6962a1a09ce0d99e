"""The anomaly log: listings, dismissal, id-keyed merges."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import timeutil as tu
from sitemetrics.sources.store import Version, Versions
from sitemetrics.sources.tables import Tables

LOG_COLUMNS = ["anomaly_id", "site_id", "site_name", "type", "severity", "message", "resolved", "dismissed",
               "detected_at", "resolved_at"]


def anomaly_log(t: Tables, as_of: datetime, sites: list[int] | None = None, severity: str | None = None) -> DataFrame:
    """Unresolved anomalies and those resolved in the last 24 hours, newest first. Dismissed ones stay listed."""
    recent = F.col("resolved_at") >= tu.ts(as_of - timedelta(hours=24))
    rows = t.anomalies.filter(~F.col("resolved") | recent)
    if sites is not None:
        rows = rows.filter(F.col("site_id").isin(*sites))
    if severity is not None:
        rows = rows.filter(F.col("severity") == severity)
    names = t.sites.select("site_id", F.col("name").alias("site_name"))
    return (rows.join(t.site_bounded(names), "site_id").select(*LOG_COLUMNS)
            .orderBy(F.desc("detected_at"), "anomaly_id"))


def anomaly_by_id(t: Tables, ids: DataFrame) -> DataFrame:
    """Lookup of many ids at once; `ids` has a column anomaly_id."""
    return (t.anomalies.join(ids.select("anomaly_id").distinct(), "anomaly_id", "left_semi")
            .select("anomaly_id", "site_id", "type", "severity", "message", "resolved", "dismissed", "detected_at"))


def dismiss(t: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anomalies after dismissal, outcome per request): unknown -> not_found, critical -> forbidden."""
    asked = requests.select("anomaly_id").distinct()
    known = t.anomalies.select("anomaly_id", "severity")
    outcome = (F.when(F.col("severity").isNull(), "not_found").when(F.col("severity") == "critical", "forbidden")
               .otherwise("dismissed"))
    outcomes = requests.join(known, "anomaly_id", "left").select("anomaly_id", outcome.alias("outcome"))
    hit = asked.withColumn("asked", F.lit(True))
    updated = (t.anomalies.join(hit, "anomaly_id", "left")
               .withColumn("dismissed", F.col("dismissed") | (F.col("asked").isNotNull() & (F.col("severity") != "critical")))
               .select(*t.anomalies.columns))
    return updated, outcomes


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Full-outer merge on anomaly_id: new rows are added, non-null values of a change win. Idempotent.

    Of several changes of one id the resolved one counts.
    """
    fields = [c for c in current.columns if c != "anomaly_id"]
    change = (changes.groupBy("anomaly_id")
              .agg(F.max_by(F.struct(*fields), F.struct("resolved", "resolved_at", "detected_at")).alias("n")))
    merged = [F.coalesce(F.col(f"n.{c}"), F.col(c)).alias(c) for c in fields]
    return current.join(change, "anomaly_id", "full").select("anomaly_id", *merged)


def upsert_into(log: Versions, changes: DataFrame) -> Version:
    """Merge changes into the next version of a stored log. A failure leaves the old version current, and a retry changes nothing twice."""
    at = log.current()
    return log.write(upsert(log.read(at), changes), at)


def merge_resolved(log: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fold resolution events into a listing: mark known ids, add unknown ones as already resolved.

    `resolved` carries anomaly_id, site_id, type, severity, message, resolved_at and may repeat an id; the
    last one counts.
    """
    fields = ["site_id", "type", "severity", "message", "resolved_at"]
    last = (resolved.groupBy("anomaly_id").agg(F.max_by(F.struct(*fields), "resolved_at").alias("r")))
    r = {c: F.col(f"r.{c}") for c in fields}
    hit = F.col("r").isNotNull()
    return (log.select("anomaly_id", *fields, "resolved").join(last, "anomaly_id", "full")
            .select("anomaly_id",
                    *[F.coalesce(F.col(c), r[c]).alias(c) for c in ("site_id", "type", "severity")],
                    F.coalesce(F.col("message"), r["message"], F.lit("")).alias("message"),
                    F.when(hit, True).otherwise(F.col("resolved")).alias("resolved"),
                    F.coalesce(r["resolved_at"], F.col("resolved_at")).alias("resolved_at")))
