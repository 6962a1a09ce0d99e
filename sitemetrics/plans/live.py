"""Registered queries: scans, live state, feed, envelope."""

from uuid import uuid4

from pyspark.sql import functions as F

from sitemetrics.functions import metrics
from sitemetrics.operators import feed, live
from sitemetrics.plans.fixture_sql import DAY, IST, NOW
from sitemetrics.plans.history import TIMELINE
from sitemetrics.plans.registry import query
from sitemetrics.schemas import TABLES
from sitemetrics.session import shared_dir
from sitemetrics.sources import tables
from sitemetrics.sources.fixtures import AS_OF

# ------------------------------------------------------------------------------------------- scans

_BEGIN = "2024-01-01 00:00:00"


def scan(fx, name, df, **more):
    """The table written as the library stores it, with all its columns, and read back by its declared schema."""
    folder = f"{shared_dir(fx.spark)}/scan-{uuid4().hex}"
    tables.write_table(df.withColumns(more), folder, name)
    return tables.read_table(fx.spark, folder, name).select(*TABLES[name].fieldNames())


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


query("scan_sites", f"select *, name || ', ' || city as address, TIMESTAMP '{_BEGIN}' as created_at, cast(null as timestamp) as updated_at from sites")(
    lambda fx: scan(fx, "sites", fx.sites, address=F.concat_ws(", ", "name", "city"), created_at=_at(_BEGIN)))
query("scan_members", "select *, joined_at as created_at from members")(lambda fx: scan(fx, "members", fx.members, created_at=F.col("joined_at")))
query("scan_visits", "select * from visits_all")(lambda fx: scan(fx, "visits", fx.visits))
query("scan_payments", """
select payment_id, member_id, site_id, cast(amount as double) as amount, plan_type, payment_type, paid_at from ledger
""")(lambda fx: fx.ledger_payments.withColumn("amount", F.col("amount").cast("double")))
query("scan_live_payments", """
select payment_id, member_id, site_id, cast(amount as double) as amount, plan_type, payment_type, paid_at, 'no ' || payment_id as notes from payments_all
""")(lambda fx: scan(fx, "payments", fx.live_payments, notes=F.concat(F.lit("no "), F.col("payment_id"))).withColumn("amount", F.col("amount").cast("double")))
query("scan_anomalies", "select * from anomalies_all")(lambda fx: scan(fx, "anomalies", fx.anomalies))

# --------------------------------------------------------------------------------------- selection

query("active_sites", """
select site_id, name, capacity, opens_min, closes_min, status from sites where status = 'active'
""")(lambda fx: live.active_sites(fx.live))

query("open_visits", "select * from visits where checked_out is null")(lambda fx: live.open_visits(fx.live.visits))

# 12:00 UTC is minute 1050 of the local day.
query("site_operating_now", """
select site_id, opens_min < 1050 and 1050 <= closes_min as open_detector,
  opens_min <= 1050 and 1050 <= closes_min as open_inclusive, opens_min <= 1050 and 1050 < closes_min as open_half_open
from sites""")(lambda fx: live.site_operating(fx.live, AS_OF))

query("open_visits_enriched", """
select v.visit_id, v.site_id, v.member_id, m.name as member_name, s.capacity
from visits v join members m on m.member_id = v.member_id join sites s on s.site_id = v.site_id
where v.checked_out is null""")(lambda fx: live.open_visits_enriched(fx.live))

query("eligible_members", """
select m.member_id, m.name as member_name, m.site_id, s.capacity
from members m join sites s on s.site_id = m.site_id
where m.status = 'active' and s.status = 'active' and 1050 between s.opens_min and s.closes_min
  and not exists (select 1 from visits v where v.member_id = m.member_id and v.checked_out is null)
""")(lambda fx: live.eligible_members(fx.live, AS_OF))

query("active_members", """
select member_id, name as member_name, site_id, plan_type from members where status = 'active'
""")(lambda fx: live.active_members(fx.live))

query("members_with_open_visit", """
select member_id, name as member_name from members
where member_id in (select member_id from visits where checked_out is null)
""")(lambda fx: live.members_with_open_visit(fx.live))

# -------------------------------------------------------------------------------------- live state

_OCC = """
select s.*, coalesce(o.n, 0) as occ from sites s
left join (select site_id, count(*) as n from visits where checked_out is null group by site_id) o on o.site_id = s.site_id"""
_TODAY = f"""
select s.site_id, cast(coalesce(sum(p.amount), 0) as double) as today_revenue from sites s
left join payments p on p.site_id = s.site_id and p.paid_at >= {DAY} and p.paid_at < {DAY} + INTERVAL '1 day'
group by s.site_id"""
_LIVE = {"occ": _OCC, "today": _TODAY}

query("live_occupancy", "select site_id, occ as current_occupancy from occ", _LIVE)(
    lambda fx: live.live_occupancy(fx.live))
query("today_revenue", "select * from today", _LIVE)(lambda fx: live.today_revenue(fx.live, AS_OF))

query("revenue_today_vs_last_week", f"""
select s.site_id,
  cast(coalesce(sum(case when paid_at >= {DAY} then amount end), 0) as double) as today_total,
  cast(coalesce(sum(case when paid_at >= {DAY} - INTERVAL '7 days' and paid_at < {DAY} - INTERVAL '6 days'
    then amount end), 0) as double) as last_week_total
from sites s left join payments p on p.site_id = s.site_id group by s.site_id
""")(lambda fx: live.revenue_today_vs_last_week(fx.live, AS_OF).withColumns(
    {c: F.col(c).cast("double") for c in ("today_total", "last_week_total")}))

query("recent_visit_count", f"""
select s.site_id, count(v.visit_id) as recent_count from sites s
left join visits v on v.site_id = s.site_id and v.checked_in >= {NOW} - INTERVAL '2 hours' group by s.site_id
""")(lambda fx: live.recent_visit_count(fx.live, AS_OF))

query("site_overview", """
select o.site_id, o.name, o.city, o.capacity, o.status, o.occ as current_occupancy, t.today_revenue
from occ o join today t on t.site_id = o.site_id""", _LIVE)(lambda fx: live.site_overview(fx.live, AS_OF))

query("fleet_summary", f"""
select (select count(*) from visits join sites using (site_id) where checked_out is null) as total_occupancy,
  (select cast(coalesce(sum(amount), 0) as double) from payments join sites using (site_id)
   where paid_at >= {DAY} and paid_at < {DAY} + INTERVAL '1 day') as total_revenue
""")(lambda fx: live.fleet_summary(fx.live, AS_OF))

# Half-up rounding in integers: tenths of a percent = (2000 occ + cap) div (2 cap).
query("occupancy_status", """
select site_id, current_occupancy, capacity, capacity_pct,
  case when capacity_pct < 60 then 'NORMAL' when capacity_pct <= 85 then 'BUSY' else 'CRITICAL' end as band,
  least(capacity_pct, 100.0::double) as bar_pct
from (select site_id, occ as current_occupancy, capacity,
  case when capacity > 0 then ((occ * 2000 + capacity) // (2 * capacity)) / 10.0::double else 0.0::double end as capacity_pct
  from occ) q""", _LIVE)(lambda fx: live.occupancy_status(fx.live))

# -------------------------------------------------------------------------------------------- feed

_FEED = {
    "feed_events": """
select site_id, cast(visit_id as varchar) || '-in' as id, 'checkin' as event_type, member_id, checked_in as event_time,
  'checked_in' as action, cast(null as decimal(12,2)) as amount, cast(null as varchar) as plan_type from visits
union all
select site_id, cast(visit_id as varchar) || '-out', 'checkout', member_id, checked_out, 'checked_out', null, null
from visits where checked_out is not null
union all
select site_id, cast(payment_id as varchar), 'payment', member_id, paid_at, 'paid', amount, plan_type from payments""",
    "feed": """
select e.site_id, e.id, e.event_type, e.member_id, m.name as member_name, e.event_time, e.action,
  cast(e.amount as double) as amount, e.plan_type
from (select *, row_number() over (partition by site_id order by event_time desc, id) as rn from feed_events) e
left join members m on m.member_id = e.member_id where rn <= 20""",
}
query("activity_feed", "select * from feed", _FEED)(
    lambda fx: feed.activity_feed(fx.live).withColumn("amount", F.col("amount").cast("double")))

query("event_labels", """
select site_id, id, event_type,
  case event_type when 'checkout' then 'OUT' when 'payment' then 'PAID' else 'IN' end as label from feed_events""", _FEED)(
    lambda fx: feed.feed_events(fx.live).select("site_id", "id", "event_type",
                                                metrics.event_label(F.col("event_type")).alias("label")))

query("open_anomalies", """
select site_id, anomaly_id, type, severity, message, detected_at from anomalies where not resolved
""")(lambda fx: feed.open_anomalies(fx.live))

query("unread_anomalies", """
select site_id, count(*) as unread_count from anomalies where not (resolved and dismissed) group by site_id
""")(lambda fx: feed.unread_anomalies(fx.live))


@query("live_snapshot", """
select o.site_id, o.occ as current_occupancy, t.today_revenue, coalesce(f.n, 0) as events, f.newest_id,
  coalesce(a.n, 0) as anomalies, a.newest_anomaly
from occ o join today t on t.site_id = o.site_id
left join (select site_id, count(*) as n, max_by(id, (event_time, id)) as newest_id from feed group by site_id) f
  on f.site_id = o.site_id
left join (select site_id, count(*) as n, max_by(anomaly_id, (detected_at, anomaly_id)) as newest_anomaly
  from anomalies where not resolved group by site_id) a on a.site_id = o.site_id""", {**_LIVE, **_FEED})
def live_snapshot(fx):
    """The nested document, flattened for comparison."""
    s = feed.live_snapshot(fx.live, AS_OF)
    return s.select("site_id", "current_occupancy", "today_revenue",
                    F.size("recent_events").cast("long").alias("events"),
                    F.get("recent_events", 0)["id"].alias("newest_id"),
                    F.size("active_anomalies").cast("long").alias("anomalies"),
                    F.get("active_anomalies", 0)["anomaly_id"].alias("newest_anomaly"))


# ---------------------------------------------------------------------------------------- envelope

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _json(*fields):
    """A JSON object from (name, SQL value, quoted) triples; null values are left out."""
    parts = [f"""case when {value} is null then '' else ',"{name}":' || {"'" + '"' + "' || " if quoted else ""}cast({value} as varchar){" || '" + '"' + "'" if quoted else ""} end"""
             for name, value, quoted in fields]
    return "'{' || substr(" + " || ".join(parts) + ", 2) || '}'"


_FIELDS = [("type", "e.type", True), ("event_id", "e.event_id", True), ("site_id", "e.site_id", False), ("site_name", "s.name", True),
           ("event_time", _ISO.format("e.event_time"), True), ("member_id", "e.member_id", False), ("member_name", "m.name", True),
           ("current_occupancy", "e.occupancy", False), ("capacity_pct", "e.pct", False), ("amount", "e.amount", False),
           ("plan_type", "e.plan_type", True), ("today_total", "e.today_total", False), ("anomaly_id", "e.anomaly_id", True),
           ("anomaly_type", "e.anomaly_type", True), ("severity", "e.severity", True), ("message", "e.message", True),
           ("resolved_at", _ISO.format("e.resolved_at"), True)]
_ENVELOPE = {
    **TIMELINE,
    "changes_sent": """
select site_id, visit_id, member_id, '-in' as side, 'CHECKIN_EVENT' as type from visits_all
union all select site_id, visit_id, member_id, '-out', 'CHECKOUT_EVENT' from visits_all where checked_out is not null""",
    "sent": f"""
select c.type, t.event_id, t.site_id, t.event_time, c.member_id, t.occupancy,
  case when p.capacity > 0 then ((t.occupancy * 2000 + p.capacity) // (2 * p.capacity)) / 10.0::double else 0.0::double end as pct,
  cast(null as decimal(12,2)) as amount, cast(null as varchar) as plan_type, cast(null as decimal(22,2)) as today_total,
  cast(null as varchar) as anomaly_id, cast(null as varchar) as anomaly_type, cast(null as varchar) as severity, cast(null as varchar) as message,
  cast(null as timestamp) as resolved_at
from changes_sent c join timeline t on t.event_id = cast(c.visit_id as varchar) || c.side left join sites p on p.site_id = t.site_id
union all
select 'PAYMENT_EVENT', cast(payment_id as varchar), site_id, paid_at, member_id, null, null, amount, plan_type,
  cast(sum(amount) over (partition by site_id, cast(paid_at + {IST} as date) order by paid_at, payment_id rows unbounded preceding) as decimal(22,2)),
  null, null, null, null, null
from payments_all
union all
select 'ANOMALY_DETECTED', anomaly_id || '-open', site_id, detected_at, null, null, null, null, null, null, anomaly_id, type, severity, message, null
from anomalies_all
union all
select 'ANOMALY_RESOLVED', anomaly_id || '-close', site_id, resolved_at, null, null, null, null, null, null, anomaly_id, null, null, null, resolved_at
from anomalies_all where resolved""",
    "messages": f"""
select e.event_id, {_json(*_FIELDS)} as payload
from sent e left join sites s on s.site_id = e.site_id left join members_live m on m.member_id = e.member_id""",
}
query("event_envelope", "select * from messages", _ENVELOPE)(lambda fx: feed.encode(feed.envelope_events(fx.all)))

_SENT_FIELDS = ["type", "event_id", "site_id", "event_time", "member_id", "current_occupancy", "amount", "plan_type", "today_total", "anomaly_id",
                "severity", "resolved_at"]
# Damage by the first digit of the id's digest, and what the reader must say.
_REASONS = {"0": "malformed", "1": "malformed", "2": "wrong type", "3": "missing event_id", "4": "unknown type", "5": "missing site_id"}


@query("event_decode", f"""
select type, event_id, site_id, event_time, member_id, occupancy as current_occupancy, cast(amount as double) as amount, plan_type,
  cast(today_total as double) as today_total, anomaly_id, severity, resolved_at, cast(null as varchar) as reason
from sent where substr(md5(event_id), 1, 1) not in ({', '.join(f"'{d}'" for d in _REASONS)})
union all
select null, null, null, null, null, null, null, null, null, null, null, null,
  case substr(md5(event_id), 1, 1) {' '.join(f"when '{d}' then '{r}'" for d, r in _REASONS.items())} end
from sent where substr(md5(event_id), 1, 1) in ({', '.join(f"'{d}'" for d in _REASONS)})
""", _ENVELOPE)
def event_decode(fx):
    """Encode everything, damage six sixteenths of the messages in six ways, decode; damaged ones must be rejected for the right reason."""
    sent = feed.encode(feed.envelope_events(fx.all))
    payload, digit = F.col("payload"), F.substring(F.md5(F.col("event_id").cast("binary")), 1, 1)
    damaged = (F.when(digit == "0", F.expr("left(payload, length(payload) - 1)")).when(digit == "1", F.concat(payload, F.lit(" {}")))
               .when(digit == "2", F.regexp_replace(payload, r'"site_id":(\d+)', '"site_id":"no $1"'))
               .when(digit == "3", F.regexp_replace(payload, '"event_id":', '"event":')).when(digit == "4", F.regexp_replace(payload, '"type":"', '"type":"OLD_'))
               .when(digit == "5", F.regexp_replace(payload, r'"site_id":\d+,', "")).otherwise(payload))
    parsed = feed.parse(sent.select(damaged.alias("payload")))
    doubles = {c: F.col(c).cast("double") for c in ("amount", "today_total")}
    return parsed.select(*[F.when(F.col("valid"), doubles.get(c, F.col(c))).alias(c) for c in _SENT_FIELDS], "reason")
