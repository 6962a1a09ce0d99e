"""Registered queries: revenue, churn, heatmap, scalar metrics, benchmark queries."""

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import metrics
from sitemetrics.functions import timeutil as tu
from sitemetrics.operators import analytics, anomalies, feed, live
from sitemetrics.plans.fixture_sql import DAY, IST, LEDGER_DAY, LEDGER_NOW, NOW
from sitemetrics.plans.registry import query
from sitemetrics.schemas import ANOMALIES
from sitemetrics.session import shared_dir
from sitemetrics.sources import loads
from sitemetrics.sources.fixtures import AS_OF, LEDGER_AS_OF
from sitemetrics.sources.store import Versions
from sitemetrics.sources.visits import VisitLog

SITE = 3

for label, days in analytics.DATE_RANGES.items():
    query(f"revenue_by_plan_{label}", f"""
select site_id, plan_type, cast(sum(amount) as double) as total_revenue from ledger
where paid_at >= {LEDGER_DAY} - INTERVAL '{days} days' and paid_at <= {LEDGER_NOW} group by site_id, plan_type
""")(lambda fx, days=days: analytics.revenue_by_plan(fx.ledger, LEDGER_AS_OF, days))
    query(f"new_vs_renewal_{label}", f"""
select site_id, payment_type as member_type, count(*) as count from ledger
where paid_at >= {LEDGER_DAY} - INTERVAL '{days} days' and paid_at <= {LEDGER_NOW} group by site_id, payment_type
""")(lambda fx, days=days: analytics.new_vs_renewal(fx.ledger, LEDGER_AS_OF, days))

query("revenue_by_plan_ranges", f"""
select site_id, plan_type,
  cast(sum(case when paid_at >= {LEDGER_DAY} - INTERVAL '7 days' then amount end) as double) as revenue_7d,
  cast(sum(case when paid_at >= {LEDGER_DAY} - INTERVAL '30 days' then amount end) as double) as revenue_30d,
  cast(sum(amount) as double) as revenue_90d
from ledger where paid_at >= {LEDGER_DAY} - INTERVAL '90 days' and paid_at <= {LEDGER_NOW} group by site_id, plan_type
""")(lambda fx: analytics.revenue_by_plan_ranges(fx.ledger, LEDGER_AS_OF))

query("revenue_30d_by_site", f"""
select site_id, cast(sum(amount) as double) as total_revenue from ledger
where paid_at >= {LEDGER_NOW} - INTERVAL '30 days' and paid_at <= {LEDGER_NOW} group by site_id
""")(lambda fx: analytics.revenue_30d_by_site(fx.ledger, LEDGER_AS_OF))

_RANK = {"takings": f"""
select site_id, sum(amount) as taken from ledger where paid_at between {LEDGER_NOW} - INTERVAL '30 days' and {LEDGER_NOW} group by site_id""",
    "totals": "select site_id, name as site_name, coalesce(taken, 0) as total from sites left join takings using (site_id)",
    "ranked": """
select site_id, site_name, cast(total as double) as total_revenue, cast(dense_rank() over (order by total desc) as integer) as rank from totals"""}
query("site_revenue_rank", "select *, rank = 1 as is_top from ranked", _RANK)(
    lambda fx: analytics.site_revenue_rank(fx.ledger, LEDGER_AS_OF))
query("site_labels", """
select site_id, upper(replace(site_name, 'NATION_', '')) as label, total_revenue, rank = 1 as is_top from ranked
""", _RANK)(lambda fx: analytics.site_labels(analytics.site_revenue_rank(fx.ledger, LEDGER_AS_OF), "NATION_"))

_CHURN = {"absence": f"""
select *, epoch_us({LEDGER_NOW}) - epoch_us(last_checkin_at) as gap from members where status = 'active'""",
    "churn": """
select member_id, site_id, name, email, phone, last_checkin_at, plan_expires_at,
  if(gap > 60 * 86400000000, 'CRITICAL', 'HIGH') as risk_level, cast(gap // 86400000000 as integer) as days_absent
from absence where gap > 45 * 86400000000"""}
query("churn_risk", "select * from churn", _CHURN)(lambda fx: analytics.churn_risk(fx.ledger, LEDGER_AS_OF))
query("churn_contact", "select member_id, coalesce(nullif(phone, ''), email) as contact from churn", _CHURN)(
    lambda fx: analytics.churn_contact(fx.ledger, LEDGER_AS_OF))
query("churn_count_by_site", "select site_id, count(*) as at_risk from churn group by site_id", _CHURN)(
    lambda fx: analytics.churn_count_by_site(fx.ledger, LEDGER_AS_OF))

# ----------------------------------------------------------------------------------------- heatmap

_HEAT = {"hourly": f"""
select site_id, cast(extract(dow from checked_in + {IST}) as integer) as day_of_week,
  cast(extract(hour from checked_in + {IST}) as integer) as hour_of_day,
  cast((2 * count(*) + 13) // 26 as integer) as checkin_count
from visits_all group by 1, 2, 3"""}
query("hourly_stats", "select * from hourly", _HEAT)(lambda fx: analytics.hourly_stats(fx.all))
query("site_heatmap", "select * from hourly", _HEAT)(lambda fx: analytics.site_heatmap(analytics.hourly_stats(fx.all)))


@query("hourly_stats_refresh", "select * from hourly", _HEAT)
def hourly_stats_refresh(fx):
    """The stored counts after a first refresh and one for the dates of an append, some of whose rows are late."""
    root = f"{shared_dir(fx.spark)}/hourly-{uuid4().hex}"
    log, counts = VisitLog(fx.spark, f"{root}/visits"), Versions(fx.spark, f"{root}/counts", analytics.HOURLY_COUNTS)
    late = (F.col("checked_in") >= F.lit("2024-01-20").cast("timestamp_ntz")) | (F.col("visit_id") % 50 == 7)
    log.open(fx.visits.filter(~late))
    analytics.refresh_hourly_counts(counts, log.read())
    log.open(fx.visits.filter(late))
    changed = [r[0] for r in fx.visits.filter(late).select(tu.local_date(F.col("checked_in"))).distinct().collect()]   # one row a date
    analytics.refresh_hourly_counts(counts, log.read(), changed)
    return analytics.stats_from_counts(counts.read())


query("heatmap_grid", """
select site_id, day_of_week, hour_of_day, checkin_count, case when checkin_count = 0 then 'none' when share < 0.25 then 'low' when share < 0.60 then 'medium'
  when share < 0.85 then 'high' else 'peak' end as band
from (select site_id, day_of_week, hour_of_day, checkin_count,
    checkin_count / greatest(1, max(checkin_count) over (partition by site_id))::double as share
  from (select s.site_id, cast(d.d as integer) as day_of_week, cast(h.h as integer) as hour_of_day,
      coalesce(q.checkin_count, 0) as checkin_count
    from sites s cross join range(7) d(d) cross join range(24) h(h)
    left join hourly q on q.site_id = s.site_id and q.day_of_week = d.d and q.hour_of_day = h.h) c) e
""", _HEAT)(
    lambda fx: analytics.heatmap_grid(fx.all))

# ---------------------------------------------------------------------------------- scalar metrics

query("visit_durations", """
select visit_id, cast((epoch_us(checked_out) - epoch_us(checked_in) + 30000000) // 60000000 as integer) as duration_min
from visits_all""")(lambda fx: analytics.visit_durations(fx.all))

query("plan_expiry", """
select member_id, plan_type, joined_at + case plan_type when 'monthly' then INTERVAL '30 days'
    when 'quarterly' then INTERVAL '90 days' else INTERVAL '365 days' end as expires_at,
  case plan_type when 'quarterly' then 3999 when 'annual' then 11999 else 1499 end as price
from members""")(lambda fx: fx.members.select(
    "member_id", "plan_type", metrics.plan_expiry(F.col("joined_at"), F.col("plan_type")).alias("expires_at"),
    metrics.plan_price(F.col("plan_type")).alias("price")))

query("traffic_multiplier", f"""
select visit_id, case when h < 5 or h = 23 then 0.0::double when h = 5 then 0.3 when h = 6 then 0.6 when h < 10 then 1.0
  when h < 12 then 0.4 when h < 14 then 0.3 when h < 17 then 0.2 when h < 21 then 0.9 else 0.35 end as multiplier
from (select visit_id, extract(hour from checked_in + {IST}) as h from visits_all) q
""")(lambda fx: fx.visits.select("visit_id", metrics.traffic_multiplier(F.col("checked_in")).alias("multiplier")))

query("visit_weight", f"""
select visit_id, case extract(dow from checked_in + {IST}) when 0 then 0.45::double when 1 then 1.0 when 2 then 0.95
  when 3 then 0.9 when 4 then 0.95 when 5 then 0.85 else 0.7 end as weight from visits_all
""")(lambda fx: fx.visits.select(
    "visit_id", metrics.visit_weight(tu.to_local("checked_in")).alias("weight")))

NAMES = ["Alba", "Bruno", "Chen", "Dina", "Emre", "Fay", "Goran"]
query("name_lookup", "select member_id, case member_id * 3 % 7 " + " ".join(
    f"when {i} then '{n}'" for i, n in enumerate(NAMES)) + " end as label from members")(
    lambda fx: fx.members.select("member_id", metrics.lookup(NAMES, F.col("member_id") * 3).alias("label")))

# --------------------------------------------------------------------------------------- anomalies

_LOG = {"log": f"""
select a.anomaly_id, a.site_id, s.name as site_name, a.type, a.severity, a.message, a.resolved, a.dismissed, a.detected_at,
  a.resolved_at from anomalies a join sites s on s.site_id = a.site_id
where not a.resolved or a.resolved_at >= {NOW} - INTERVAL '24 hours'"""}
query("anomaly_log", "select * from log", _LOG)(lambda fx: anomalies.anomaly_log(fx.live, AS_OF))
query("anomaly_log_filtered", "select * from log where site_id in (1, 3, 8) and severity = 'warning'", _LOG)(
    lambda fx: anomalies.anomaly_log(fx.live, AS_OF, [1, 3, 8], "warning"))

# Requests: the id of every order of the ledger that may or may not name an anomaly.
_REQ = {"requests": "select distinct cast(o_orderkey as varchar) as anomaly_id from orders"}


def _requests(fx):
    return fx.raw("orders").select(F.col("o_orderkey").cast("string").alias("anomaly_id")).distinct()


query("anomaly_by_id", """
select anomaly_id, site_id, type, severity, message, resolved, dismissed, detected_at from anomalies_all
where anomaly_id in (select anomaly_id from requests)""", _REQ)(lambda fx: anomalies.anomaly_by_id(fx.all, _requests(fx)))

query("dismiss_outcomes", """
select r.anomaly_id, case when a.severity is null then 'not_found' when a.severity = 'critical' then 'forbidden'
  else 'dismissed' end as outcome
from requests r left join anomalies_all a on a.anomaly_id = r.anomaly_id""", _REQ)(
    lambda fx: anomalies.dismiss(fx.all, _requests(fx))[1])

query("dismissed_anomalies", """
select anomaly_id, severity,
  dismissed or (severity <> 'critical' and anomaly_id in (select anomaly_id from requests)) as dismissed
from anomalies_all""", _REQ)(
    lambda fx: anomalies.dismiss(fx.all, _requests(fx))[0].select("anomaly_id", "severity", "dismissed"))

# Resolution events of the live clock's future: known ids are marked, ids not in the listing are added.
query("anomaly_log_merge", """
select coalesce(l.anomaly_id, r.anomaly_id) as anomaly_id, coalesce(l.site_id, r.site_id) as site_id,
  coalesce(l.type, r.type) as type, coalesce(l.severity, r.severity) as severity, coalesce(l.message, r.message) as message,
  coalesce(r.anomaly_id is not null or l.resolved, false) as resolved, coalesce(r.resolved_at, l.resolved_at) as resolved_at
from log l full join (select * from anomalies_all where resolved) r on r.anomaly_id = l.anomaly_id""", _LOG)(
    lambda fx: anomalies.merge_resolved(
        anomalies.anomaly_log(fx.live, AS_OF),
        fx.anomalies.filter("resolved").select("anomaly_id", "site_id", "type", "severity", "message", "resolved_at")))

@query("anomaly_upsert", """
select anomaly_id, site_id, type, severity, message, resolved, dismissed, detected_at, resolved_at from anomalies_all
""")
def anomaly_upsert(fx):
    """The log as of the live clock is stored, all later changes are merged into its next version, twice, and read back."""
    log = Versions(fx.spark, f"{shared_dir(fx.spark)}/anomalies-{uuid4().hex}", ANOMALIES)
    log.write(fx.live.anomalies, log.current())
    for _ in range(2):
        anomalies.upsert_into(log, fx.anomalies)
    return log.read()


@query("guarded_load", """
select 'sites' as table_name, 'loaded' as first_load, 'refused' as empty_load, count(*) as rows from sites
union all select 'members', 'loaded', 'refused', count(*) from members_live
union all select 'visits', 'loaded', 'refused', count(*) from visits_all
union all select 'payments', 'loaded', 'refused', count(*) from payments_all
union all select 'anomalies', 'loaded', 'refused', count(*) from anomalies_all""")
def guarded_load(fx):
    """All tables are loaded, an empty load is refused, and what is then current is counted."""
    folder = f"{shared_dir(fx.spark)}/load-{uuid4().hex}"
    first = loads.load_all(fx.spark, folder, fx.all)
    second = {name: outcome for name, outcome, _ in loads.load_all(fx.spark, folder, fx.all.none())}
    back = loads.read_all(fx.spark, folder)
    counts = [getattr(back, name).agg(F.lit(name).alias("table_name"), F.lit(outcome).alias("first_load"), F.lit(second[name]).alias("empty_load"),
                                      F.count(F.lit(1)).alias("rows")) for name, outcome, _ in first]
    return reduce(DataFrame.unionByName, counts)


# ------------------------------------------------------------------------- the six benchmark queries

query("bench_q1", f"""
select count(*) as current_occupancy from visits where site_id = {SITE} and checked_out is null
""")(lambda fx: live.open_visits(fx.live.visits).filter(F.col("site_id") == SITE).agg(
    F.count(F.lit(1)).alias("current_occupancy")))
query("bench_q2", f"""
select cast(coalesce(sum(amount), 0) as double) as today_revenue from payments
where site_id = {SITE} and paid_at >= {DAY} and paid_at < {DAY} + INTERVAL '1 day'
""")(lambda fx: live.today_revenue(fx.live, AS_OF).filter(F.col("site_id") == SITE).select("today_revenue"))
query("bench_q3", "select member_id, name, last_checkin_at from churn", _CHURN)(
    lambda fx: analytics.churn_risk(fx.ledger, LEDGER_AS_OF).select("member_id", "name", "last_checkin_at"))
query("bench_q4", f"select * from hourly where site_id = {SITE}", _HEAT)(
    lambda fx: analytics.hourly_stats(fx.all.only([SITE])))
query("bench_q5", f"""
select site_id, cast(sum(amount) as double) as total_revenue from ledger
where paid_at >= {LEDGER_NOW} - INTERVAL '30 days' and paid_at <= {LEDGER_NOW} group by site_id
""")(lambda fx: analytics.revenue_30d_by_site(fx.ledger, LEDGER_AS_OF))
query("bench_q6", "select site_id, anomaly_id, type, severity, message, detected_at from anomalies where not resolved")(
    lambda fx: feed.open_anomalies(fx.live))
