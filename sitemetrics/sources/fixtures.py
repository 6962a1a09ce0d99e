"""Adapters from the supplied star-schema tables to sites, members, visits, payments and anomalies.

Two payment sets exist because the supplied tables cover two periods: `live` (events, January 2024)
and `ledger` (orders, 1995 to 2001).
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemetrics.functions import metrics
from sitemetrics.functions import timeutil as tu
from sitemetrics.operators import episodes
from sitemetrics.sources.tables import Tables
from sitemetrics.streaming import runner

RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

AS_OF = datetime(2024, 1, 30, 12, 0)          # 17:30 local: every site is within its hours
LEDGER_AS_OF = datetime(2001, 6, 1)


class Fixture:
    """Lazily adapted tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def sites(self) -> DataFrame:
        heads = self.raw("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("heads"))
        key = F.col("n_nationkey")
        return (self.raw("nation")
                .join(self.raw("region"), F.col("r_regionkey") == F.col("n_regionkey"))
                .join(heads, F.col("c_nationkey") == key, "left")
                .select(key.alias("site_id"), F.col("n_name").alias("name"), F.col("r_name").alias("city"),
                        F.when(key % 10 == 9, "maintenance").otherwise("active").alias("status"),
                        F.floor((F.coalesce("heads", F.lit(0)) * (key % 9 + 12) + 9) / 10).cast("int").alias("capacity"),
                        (key % 3 * 30 + 300).alias("opens_min"), (key % 4 * 30 + 1260).alias("closes_min")))

    @cached_property
    def visits(self) -> DataFrame:
        stay = F.make_dt_interval(secs=F.col("event_id") % 2701 + 2700)
        return (self.raw("events").filter(F.col("event_type").isin("view", "click", "signup"))
                .select(F.col("event_id").alias("visit_id"), F.col("user_id").alias("member_id"),
                        (F.col("user_id") % 25).cast("int").alias("site_id"), F.col("ts").alias("checked_in"),
                        F.when(F.col("event_type") != "signup", F.col("ts") + stay).alias("checked_out")))

    @cached_property
    def live_payments(self) -> DataFrame:
        n = F.col("event_id")
        return (self.raw("events").filter(F.col("event_type") == "purchase")
                .select(n.alias("payment_id"), F.col("user_id").alias("member_id"),
                        (F.col("user_id") % 25).cast("int").alias("site_id"),
                        F.col("value").cast("decimal(12,2)").alias("amount"), _plan(n).alias("plan_type"),
                        F.when(n % 5 == 0, "renewal").otherwise("new").alias("payment_type"),
                        F.col("ts").alias("paid_at")))

    @cached_property
    def ledger_payments(self) -> DataFrame:
        return (self.raw("orders").join(self.raw("customer"), F.col("c_custkey") == F.col("o_custkey"))
                .select(F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("member_id"),
                        F.col("c_nationkey").alias("site_id"),
                        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
                        F.col("o_orderpriority").alias("plan_type"),
                        F.when(F.col("o_orderstatus") == "F", "renewal").otherwise("new").alias("payment_type"),
                        F.col("o_orderdate").alias("paid_at")))

    @cached_property
    def members(self) -> DataFrame:
        last = (self.raw("orders").filter(F.col("o_orderdate") < tu.ts(LEDGER_AS_OF))
                .groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_checkin_at")))
        n = F.col("c_custkey")
        joined = tu.ts(LEDGER_AS_OF) - F.make_dt_interval(days=(n % 400).cast("int"))
        phone = F.concat((n % 3 + 7).cast("string"), F.lpad(n.cast("string"), 9, "0"))
        return (self.raw("customer").join(last, n == F.col("o_custkey"), "left")
                .select(n.alias("member_id"), F.col("c_nationkey").alias("site_id"), F.col("c_name").alias("name"),
                        F.when(n % 7 == 0, "").otherwise(phone).alias("phone"),
                        F.lower(F.concat("c_name", F.lit("@example.com"))).alias("email"),
                        _plan(n).alias("plan_type"),
                        F.when(n % 5 == 0, "renewal").otherwise("new").alias("member_type"),
                        F.when(n % 10 == 0, "inactive").when(n % 10 == 1, "frozen").otherwise("active").alias("status"),
                        joined.alias("joined_at"),
                        (joined + F.make_dt_interval(days=metrics.plan_days(_plan(n)) + F.when(n % 50 == 0, 1).otherwise(0))
                         ).alias("plan_expires_at"),
                        "last_checkin_at"))

    @cached_property
    def anomalies(self) -> DataFrame:
        n = F.col("event_id")
        kind = F.when(n % 3 == 0, "zero_checkins").when(n % 3 == 1, "capacity_breach").otherwise("revenue_drop")
        errors = (self.raw("events").filter(F.col("event_type") == "error")
                  .select("event_id", "ts", (F.col("user_id") % 25).cast("int").alias("site_id"), kind.alias("type")))
        # The newest anomaly of a site and type stays open when its id is odd; 25 x 3 keys, so 75 rows.
        newest = F.broadcast(errors.groupBy("site_id", "type").agg(F.max("event_id").alias("last_id")))
        resolved = (n != F.col("last_id")) | (n % 2 == 0)
        return (errors.join(newest, ["site_id", "type"])
                .select(n.cast("string").alias("anomaly_id"), "site_id", "type",
                        F.when(n % 3 == 1, "critical").otherwise("warning").alias("severity"),
                        F.concat("type", F.lit(" #"), n.cast("string")).alias("message"),
                        resolved.alias("resolved"), ((n % 3 != 1) & (n % 4 == 0)).alias("dismissed"),
                        F.col("ts").alias("detected_at"),
                        F.when(resolved, F.col("ts") + F.make_dt_interval(mins=(n % 60 + 5).cast("int"))).alias("resolved_at")))

    @cached_property
    def deltas(self) -> DataFrame:
        """Occupancy changes of all visits."""
        return episodes.visit_deltas(self.visits)

    @cached_property
    def capacity(self) -> DataFrame:
        return self.sites.select("site_id", "capacity")

    @cached_property
    def live_members(self) -> DataFrame:
        """Members with their clocks moved from the ledger's period to the live one."""
        shift = F.make_dt_interval(hours=F.lit(int((AS_OF - LEDGER_AS_OF).total_seconds()) // 3600))
        return self.members.withColumns({c: F.col(c) + shift for c in ("joined_at", "plan_expires_at", "last_checkin_at")})

    @cached_property
    def all(self) -> Tables:
        """Whole live period."""
        return Tables(self.sites, self.live_members, self.visits, self.live_payments, self.anomalies)

    @cached_property
    def live(self) -> Tables:
        """The live period as it stood at AS_OF."""
        return self.all.rewind(AS_OF)

    @cached_property
    def ledger(self) -> Tables:
        return Tables(self.sites, self.members, self.visits, self.ledger_payments, self.anomalies)

    def event_stream(self, folder: str | None = None, max_files: int | None = None) -> DataFrame:
        """The event table (or a folder of its slices) as a stream of typed events."""
        return self.to_events(runner.event_source(self.spark, folder or f"{self.folder}/events.parquet*", RAW["events"],
                                                  max_files=max_files))

    def to_events(self, raw: DataFrame) -> DataFrame:
        """Raw rows to events: a visit gives one or two moves, a purchase a payment, an error an anomaly."""
        n, kind = F.col("event_id"), F.col("event_type")
        text = n.cast("string")
        at = F.col("ts").cast("timestamp")
        stay = F.make_dt_interval(secs=n % 2701 + 2700)
        rule = F.when(n % 3 == 0, "zero_checkins").when(n % 3 == 1, "capacity_breach").otherwise("revenue_drop")
        none = F.lit(None)

        def event(condition, ident, label, when, delta=none, amount=none, plan=none, member=F.col("user_id"),
                  anomaly=none, what=none, severity=none, message=none):
            return F.when(condition, F.struct(
                ident.alias("event_id"), F.lit(label).alias("kind"), member.cast("long").alias("member_id"),
                when.alias("event_time"), delta.cast("int").alias("delta"), amount.cast("decimal(12,2)").alias("amount"),
                plan.cast("string").alias("plan_type"), anomaly.cast("string").alias("anomaly_id"),
                what.cast("string").alias("anomaly_type"), severity.cast("string").alias("severity"),
                message.cast("string").alias("message")))
        alert = dict(member=none, anomaly=text, what=rule, severity=F.when(n % 3 == 1, "critical").otherwise("warning"),
                     message=F.concat(rule, F.lit(" #"), text))
        events = F.array(
            event(kind.isin("view", "click", "signup"), F.concat(text, F.lit("-in")), "in", at, F.lit(1)),
            event(kind.isin("view", "click"), F.concat(text, F.lit("-out")), "out", at + stay, F.lit(-1)),
            event(kind == "purchase", text, "payment", at, amount=F.col("value"), plan=_plan(n)),
            event(kind == "error", F.concat(text, F.lit("-open")), "detected", at, **alert),
            event((kind == "error") & (n % 20 != 0), F.concat(text, F.lit("-close")), "resolved",
                  at + F.make_dt_interval(mins=(n % 60 + 5).cast("int")), **alert))
        return (raw.select((F.col("user_id") % 25).cast("int").alias("site_id"),
                           F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
                .select("site_id", "e.*"))

    def deliveries(self, inbox: str, order: tuple[int, ...] = (0, 1, 3, 2), slices: int = 4):
        """Append the event table to `inbox` in time slices, in the given order; yields after each one."""
        events = self.raw("events")
        lo, hi = events.agg(F.min(tu.micros(F.col("ts"))), F.max(tu.micros(F.col("ts")))).first()
        width = (hi - lo) // slices + 1 if lo is not None else 1
        place = F.coalesce(F.floor((tu.micros(F.col("ts")) - F.lit(lo or 0)) / F.lit(width)), F.lit(0))
        for k in order:
            events.filter(place == k).write.mode("append").parquet(inbox)
            yield k


def _plan(n):
    return F.when(n % 3 == 0, "monthly").when(n % 3 == 1, "quarterly").otherwise("annual")
