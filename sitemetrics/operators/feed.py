"""Activity feed, event envelope and the nested live snapshot."""

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sitemetrics.functions import metrics
from sitemetrics.functions import timeutil as tu
from sitemetrics.functions.timeutil import DEFAULT_TZ
from sitemetrics.operators import episodes, live
from sitemetrics.schemas import ENVELOPE, EVENT_TYPES, REQUIRED
from sitemetrics.sources.tables import Tables

FEED_SIZE = 20
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def feed_events(t: Tables) -> DataFrame:
    """Check-ins, check-outs and payments as one relation; absent fields are typed NULLs."""
    no_amount, no_plan = F.lit(None).cast("decimal(12,2)"), F.lit(None).cast("string")

    def event(ident, kind, when, action):
        return F.struct(ident.alias("id"), F.lit(kind).alias("event_type"), F.col(when).alias("event_time"),
                        F.lit(action).alias("action"))

    # Both ends of a visit come from one scan.
    visit_id = F.col("visit_id").cast("string")
    ends = F.array(event(F.concat(visit_id, F.lit("-in")), "checkin", "checked_in", "checked_in"),
                   event(F.concat(visit_id, F.lit("-out")), "checkout", "checked_out", "checked_out"))
    columns = ["site_id", "id", "event_type", "member_id", "event_time", "action", "amount", "plan_type"]
    moves = (t.visits.select("site_id", "member_id", F.explode(ends).alias("e")).select("site_id", "member_id", "e.*")
             .filter(F.col("event_time").isNotNull())
             .withColumns({"amount": no_amount, "plan_type": no_plan}).select(*columns))
    paid = (t.payments.withColumns({"id": F.col("payment_id").cast("string"), "event_type": F.lit("payment"),
                                    "event_time": F.col("paid_at"), "action": F.lit("paid")}).select(*columns))
    return moves.unionByName(paid)


def newest(events: DataFrame, n: int = FEED_SIZE) -> DataFrame:
    """The n newest events of each site; ties go to the smaller id.

    The limit on row_number is applied per input task before the shuffle (WindowGroupLimit), so a busy
    site sends n rows a task.
    """
    order = Window.partitionBy("site_id").orderBy(F.desc("event_time"), "id")
    return events.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).drop("rn")


def activity_days(t: Tables, tz: str = DEFAULT_TZ) -> DataFrame:
    """Events of each site and local date (a visit's date is that of its check-in): count, oldest and newest event time.

    Rows of parts of the tables add up, so stored tables keep it as a small table of its own, appended with the facts."""
    visits, payments = _dated(t, tz)
    ends = F.greatest("checked_in", "checked_out")
    parts = (visits.groupBy("site_id", "local_date").agg((F.count("checked_in") + F.count("checked_out")).alias("events"),
                                                         F.min(F.least("checked_in", "checked_out")).alias("oldest"), F.max(ends).alias("newest"))
             .unionByName(payments.groupBy("site_id", "local_date").agg(F.count("paid_at").alias("events"), F.min("paid_at").alias("oldest"),
                                                                        F.max("paid_at").alias("newest"))))
    return merged_days(parts)


def merged_days(parts: DataFrame) -> DataFrame:
    return parts.groupBy("site_id", "local_date").agg(F.sum("events").alias("events"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))


def _dated(t: Tables, tz: str) -> tuple[DataFrame, DataFrame]:
    """Visits and payments with their local date; stored tables have it as partition column."""
    return tuple(df if "local_date" in df.columns else df.withColumn("local_date", tu.local_date(F.col(at), tz))
                 for df, at in ((t.visits, "checked_in"), (t.payments, "paid_at")))


def recent_enough(t: Tables, n: int, tz: str = DEFAULT_TZ) -> Tables:
    """Only the dates of each site that can hold its newest n events.

    The dates of latest start that together have n events give a threshold, the oldest event among them: the n newest are not older. Needed are
    the dates with an event at or after it. On stored tables these few rows prune the partitions that are read.
    """
    days = merged_days(t.activity) if t.activity is not None else activity_days(t, tz)
    later = Window.partitionBy("site_id").orderBy(F.desc("oldest")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("site_id")
    first = F.min(F.when(F.col("later") < n, F.col("oldest"))).over(every)
    needed = (days.filter("events > 0").withColumn("later", F.coalesce(F.sum("events").over(later), F.lit(0))).withColumn("since", first)
              .filter(F.col("newest") >= F.col("since")).select(F.col("site_id").alias("of_site"), F.col("local_date").alias("of_date")))

    def kept(df):
        return df.join(needed, F.col("site_id").eqNullSafe(F.col("of_site")) & (F.col("local_date") == F.col("of_date")), "left_semi")
    visits, payments = _dated(t, tz)
    return replace(t, visits=kept(visits), payments=kept(payments))


def activity_feed(t: Tables, n: int = FEED_SIZE) -> DataFrame:
    """Newest n events of each site with member names, joined after the cut; the name of an unknown member is null."""
    top = t.site_bounded(newest(feed_events(recent_enough(t, n)), n), n)
    return (top.join(t.members.select("member_id", F.col("name").alias("member_name")), "member_id", "left")
            .select("site_id", "id", "event_type", "member_id", "member_name", "event_time", "action", "amount",
                    "plan_type"))


def open_anomalies(t: Tables) -> DataFrame:
    return (t.anomalies.filter(~F.col("resolved"))
            .select("site_id", "anomaly_id", "type", "severity", "message", "detected_at")
            .orderBy(F.desc("detected_at"), "anomaly_id"))


def live_snapshot(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ, n: int = FEED_SIZE) -> DataFrame:
    """One nested row a site: occupancy, revenue, newest events, open anomalies (newest first)."""
    item = F.struct(F.col("event_time"), F.col("id"), F.col("event_type"), F.col("member_id"), F.col("member_name"),
                    F.col("action"), F.col("amount"), F.col("plan_type"))
    events = activity_feed(t, n).groupBy("site_id").agg(
        F.reverse(F.array_sort(F.collect_list(item))).alias("recent_events"))
    # Bounded by the rule "one open anomaly per site and type"; the array is the page's content.
    alert = F.struct("detected_at", "anomaly_id", "type", "severity", "message")
    alerts = (t.anomalies.filter(~F.col("resolved")).groupBy("site_id")
              .agg(F.reverse(F.array_sort(F.collect_list(alert))).alias("active_anomalies")))
    none_e = F.lit(None).cast("array<struct<event_time:timestamp_ntz,id:string,event_type:string,member_id:bigint,"
                              "member_name:string,action:string,amount:decimal(12,2),plan_type:string>>")
    none_a = F.lit(None).cast("array<struct<detected_at:timestamp_ntz,anomaly_id:string,type:string,severity:string,"
                              "message:string>>")
    overview = live.site_overview(t, as_of, tz).select("site_id", "current_occupancy", "today_revenue")
    return (overview.join(events, "site_id", "left").join(alerts, "site_id", "left")
            .select("site_id", "current_occupancy", "today_revenue",
                    F.coalesce("recent_events", none_e, F.array()).alias("recent_events"),
                    F.coalesce("active_anomalies", none_a, F.array()).alias("active_anomalies")))


def occupancy_after(visits: DataFrame) -> DataFrame:
    """Check-ins and check-outs (site_id, member_id, event_id, event_time, delta) with the occupancy after each."""
    moves = episodes.visit_deltas(visits, "member_id")
    stepped = episodes.steps(moves)
    blocks = episodes.chained(episodes.summaries(stepped)).select("site_id", "block", "carry")
    return (stepped.join(blocks, ["site_id", "block"])
            .withColumn("current_occupancy", F.col("s") + F.greatest(F.col("carry"), -F.col("m"))).drop("block", "s", "m", "carry"))


def day_totals(payments: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Payments with today_total, the site's takings of the local day up to and with each.

    Running sums inside quarters of an hour, which local days are made of, plus the quarters before: one row a site and quarter."""
    inside = Window.partitionBy("site_id", "quarter").orderBy("paid_at", "payment_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (payments.withColumn("quarter", tu.quarter("paid_at")).filter(F.col("site_id").isNotNull())
            .withColumn("part", F.sum("amount").over(inside)))
    sums = rows.groupBy("site_id", "quarter").agg(F.sum("amount").alias("taken"))
    earlier = Window.partitionBy("site_id", tu.local_date(F.col("quarter"), tz)).orderBy("quarter").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("site_id", "quarter", F.coalesce(F.sum("taken").over(earlier), F.lit(0)).alias("before"))
    return (rows.join(before, ["site_id", "quarter"]).withColumn("today_total", (F.col("part") + F.col("before")).cast("decimal(22,2)"))
            .drop("quarter", "part", "before"))


def envelope_events(t: Tables, tz: str = DEFAULT_TZ) -> DataFrame:
    """All changes as envelope rows (typed, not yet encoded); rows without a site have no envelope."""
    names = t.members.select("member_id", F.col("name").alias("member_name"))
    sites = t.site_bounded(t.sites.select("site_id", F.col("name").alias("site_name"), "capacity"))
    kind = F.when(F.col("delta") > 0, EVENT_TYPES[0]).otherwise(EVENT_TYPES[1])
    moves = occupancy_after(t.visits).select(kind.alias("type"), "event_id", "site_id", "event_time", "member_id", "current_occupancy")
    paid = day_totals(t.payments, tz).select(F.lit(EVENT_TYPES[2]).alias("type"), F.col("payment_id").cast("string").alias("event_id"), "site_id",
                                             F.col("paid_at").alias("event_time"), "member_id", "amount", "plan_type", "today_total")
    people = moves.unionByName(paid, allowMissingColumns=True).join(names, "member_id", "left")
    found = t.anomalies.select(F.lit(EVENT_TYPES[3]).alias("type"), F.concat("anomaly_id", F.lit("-open")).alias("event_id"),
                               "site_id", F.col("detected_at").alias("event_time"), "anomaly_id",
                               F.col("type").alias("anomaly_type"), "severity", "message")
    solved = t.anomalies.filter("resolved").select(
        F.lit(EVENT_TYPES[4]).alias("type"), F.concat("anomaly_id", F.lit("-close")).alias("event_id"),
        "site_id", F.col("resolved_at").alias("event_time"), "anomaly_id", "resolved_at")
    every = people.unionByName(found, allowMissingColumns=True).unionByName(solved, allowMissingColumns=True).join(sites, "site_id", "left")
    percent = F.when(F.col("current_occupancy").isNotNull(), metrics.capacity_pct(F.col("current_occupancy"), F.col("capacity")))
    return every.withColumn("capacity_pct", percent).select(*ENVELOPE.fieldNames())


def encode(events: DataFrame) -> DataFrame:
    """One JSON message a row; absent fields are left out."""
    fields = [F.date_format(c, ISO).alias(c) if c in ("event_time", "resolved_at") else F.col(c) for c in ENVELOPE.fieldNames()]
    return events.select("event_id", F.to_json(F.struct(*fields)).alias("payload"))


def parse(messages: DataFrame) -> DataFrame:
    """Messages with their fields, `valid`, and the reason where they are not.

    malformed: not one JSON object with nothing behind it; wrong type: a field that does not fit the schema, or a time that cannot be
    read; unknown type; missing <field>: the first absent field that the type requires. Unknown fields are ignored.
    """
    damaged = "_corrupt_record"
    read = StructType([*ENVELOPE.fields, StructField(damaged, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": damaged}
    # As the only element of an array a message is whole only if nothing follows it.
    alone = F.from_json(F.concat(F.lit("["), "payload", F.lit("]")), "array<struct<type:string>>")
    # Each step is used several times by the next: parsed once, times read once, then judged.
    parsed = messages.select("payload", F.from_json("payload", read, options).alias("e"), F.coalesce(F.size(alone), F.lit(0)).alias("objects"))
    parsed = parsed.select("payload", "objects", "e.*", F.col("e").isNull().alias("absent"),
                           *[F.try_to_timestamp(F.col(f"e.{c}"), F.lit(ISO)).cast("timestamp_ntz").alias(f"{c}_read") for c in ("event_time", "resolved_at")])
    times = {c: F.col(f"{c}_read") for c in ("event_time", "resolved_at")}
    unread = [F.col(c).isNotNull() & value.isNull() for c, value in times.items()]
    kind = F.col("type")
    missing = F.lit(None).cast("string")
    for name, fields in REQUIRED.items():
        first = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in fields])
        missing = F.when(kind == name, first).otherwise(missing)
    reason = (F.when(F.col("absent") | (F.col("objects") != 1), "malformed")
              .when(F.col(damaged).isNotNull() | unread[0] | unread[1], "wrong type")
              .when(~F.coalesce(kind.isin(*EVENT_TYPES), F.lit(False)), "unknown type").otherwise(missing))
    fields = [times.get(c, F.col(c)).alias(c) for c in ENVELOPE.fieldNames()]
    return parsed.select("payload", reason.alias("reason"), *fields).select("payload", F.col("reason").isNull().alias("valid"), "reason", *ENVELOPE.fieldNames())


def decode(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected messages with the reason). Both are stateless, also on streams, where each has a sink of its own."""
    parsed = parse(messages)
    return parsed.filter("valid").select(*ENVELOPE.fieldNames()), parsed.filter(~F.col("valid")).select("payload", "reason")


def unread_anomalies(t: Tables) -> DataFrame:
    """Unread = not both resolved and dismissed."""
    return (t.anomalies.filter(~(F.col("resolved") & F.col("dismissed")))
            .groupBy("site_id").agg(F.count(F.lit(1)).alias("unread_count")))
