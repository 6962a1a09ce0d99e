"""Registered queries: the rules at one instant and over history."""

from pyspark.sql import functions as F

from sitemetrics.operators import detect, episodes
from sitemetrics.plans.fixture_sql import DAY, IST, NOW
from sitemetrics.plans.registry import query
from sitemetrics.sources.fixtures import AS_OF

# Revenue in cents keeps the SQL rounding in integers.
RULES = {
    "zero": f"""
select s.site_id, s.name as site_name, count(v.visit_id) as recent_count,
  s.opens_min < 1050 and 1050 <= s.closes_min and count(v.visit_id) = 0 as trigger, count(v.visit_id) > 0 as resolve,
  'Zero check-ins recorded in the last 2 hours during operating hours at ' || s.name || '.' as message
from sites s left join visits v on v.site_id = s.site_id and v.checked_in >= {NOW} - INTERVAL '2 hours'
where s.status = 'active' group by s.site_id, s.name, s.opens_min, s.closes_min""",
    "load": """
select s.site_id, s.name as site_name, s.capacity, count(v.visit_id) as occ from sites s
left join visits v on v.site_id = s.site_id and v.checked_out is null
where s.status = 'active' group by s.site_id, s.name, s.capacity""",
    "capacity": """
select site_id, site_name, occ as current_occupancy, capacity, capacity > 0 and occ * 100 > capacity * 90 as trigger,
  capacity > 0 and occ * 100 < capacity * 85 as resolve, pct,
  'Capacity breach detected at ' || site_name || '! Occupancy is at ' || printf('%.1f', pct) || '% (' || occ || '/' || capacity
  || ').' as message
from (select *, case when capacity > 0 then ((occ * 2000 + capacity) // (2 * capacity)) / 10.0::double end as pct from load) q""",
    "week": f"""
select s.site_id, s.name as site_name,
  cast(coalesce(sum(case when paid_at >= {DAY} then amount end), 0) * 100 as bigint) as today,
  cast(coalesce(sum(case when paid_at >= {DAY} - INTERVAL '7 days' and paid_at < {DAY} - INTERVAL '6 days'
    then amount end), 0) * 100 as bigint) as before
from sites s left join payments p on p.site_id = s.site_id where s.status = 'active' group by s.site_id, s.name""",
    "revenue": """
select site_id, site_name, today / 100.0::double as today_total, before / 100.0::double as last_week_total,
  before > 0 and today * 100 <= before * 70 as trigger, before > 0 and today * 100 >= before * 80 as resolve, drop_pct,
  'Significant revenue drop detected at ' || site_name || '. Revenue today is down ' || printf('%.1f', drop_pct)
  || '% vs last week.' as message
from (select *, case when before > 0 then
    sign(before - today) * ((abs(before - today) * 2000 + before) // (2 * before)) / 10.0::double end as drop_pct from week) q""",
    "flags": """
select site_id, site_name, 'zero_checkins' as type, 'warning' as severity, trigger, resolve, message from zero
union all select site_id, site_name, 'capacity_breach', 'critical', trigger, resolve, message from capacity
union all select site_id, site_name, 'revenue_drop', 'warning', trigger, resolve, message from revenue""",
    "opened_keys": "select site_id, type, count(*) as n from anomalies where not resolved group by site_id, type",
    "acts": """
select f.*, case when f.trigger and coalesce(o.n, 0) = 0 then 'open' when f.resolve and coalesce(o.n, 0) > 0 then 'resolve'
  else 'keep' end as action
from flags f left join opened_keys o on o.site_id = f.site_id and o.type = f.type""",
    "opened": f"""
select sha256(site_id || ':' || type || ':2024-01-30 12:00:00') as anomaly_id, site_id, type, severity, message,
  false as resolved, false as dismissed, {NOW} as detected_at, cast(null as timestamp) as resolved_at
from acts where action = 'open'""",
    "closed": f"""
select a.anomaly_id, a.site_id, a.type, a.severity, a.message, true as resolved, a.dismissed, a.detected_at, {NOW} as resolved_at
from anomalies a join acts x on x.site_id = a.site_id and x.type = a.type and x.action = 'resolve' where not a.resolved""",
}
query("rule_zero_visits", "select * from zero", RULES)(lambda fx: detect.rule_zero_visits(fx.live, AS_OF))
query("rule_capacity", "select * from capacity", RULES)(lambda fx: detect.rule_capacity(fx.live, AS_OF))
query("rule_revenue_drop", """
select site_id, site_name, today_total, last_week_total, trigger, resolve, drop_pct, message from revenue
""", RULES)(lambda fx: detect.rule_revenue_drop(fx.live, AS_OF))
query("detect_actions", "select site_id, type, severity, trigger, resolve, action from acts", RULES)(
    lambda fx: detect.actions(fx.live, AS_OF).select("site_id", "type", "severity", "trigger", "resolve", "action"))
query("anomalies_detected", "select * from opened", RULES)(lambda fx: detect.opened(detect.actions(fx.live, AS_OF), AS_OF))
query("anomalies_resolved", "select * from closed", RULES)(lambda fx: detect.resolved(fx.live, detect.actions(fx.live, AS_OF), AS_OF))
query("detect_changes", "select * from opened union all select * from closed", RULES)(lambda fx: detect.detect_changes(fx.live, AS_OF))
query("detect_step", """
select * from anomalies where anomaly_id not in (select anomaly_id from closed)
union all select * from closed union all select * from opened""", RULES)(lambda fx: detect.detect_step(fx.live, AS_OF)[0])
query("detect_events", f"""
select 'ANOMALY_DETECTED' as type, site_id, anomaly_id, type as anomaly_type, severity, message, {NOW} as event_time from opened
union all select 'ANOMALY_RESOLVED', site_id, anomaly_id, null, null, null, {NOW} from closed""", RULES)(
    lambda fx: detect.detect_step(fx.live, AS_OF)[1])

# --------------------------------------------------------------------------------- capacity replay

TIMELINE = {
    "running": """
select *, sum(delta) over (partition by site_id order by event_time, event_id rows unbounded preceding) as s from deltas""",
    "lowest": """
select *, min(s) over (partition by site_id order by event_time, event_id rows unbounded preceding) as m from running""",
    "timeline": "select site_id, event_time, event_id, cast(s - least(0, m) as bigint) as occupancy from lowest",
    "marks": """
select t.*, case when s.capacity > 0 and occupancy * 100 > s.capacity * 90 then 1
  when s.capacity > 0 and occupancy * 100 < s.capacity * 85 then 0 end as mark
from timeline t left join sites s on s.site_id = t.site_id""",
    "states": """
select *, coalesce(last_value(mark ignore nulls) over (partition by site_id order by event_time, event_id
  rows between unbounded preceding and current row), 0) as state from marks""",
    "changes": """
select * from (select *, lag(state, 1, 0) over (partition by site_id order by event_time, event_id) as before from states) q
where state <> before""",
    "paired": """
select site_id, event_time as opened_at, occupancy as opened_occupancy, state,
  lead(event_time) over (partition by site_id order by event_time, event_id) as closed_at from changes""",
}


query("occupancy_timeline", "select site_id, event_time, event_id, occupancy from timeline", TIMELINE)(
    lambda fx: episodes.occupancy_timeline(fx.deltas).drop("block"))
query("capacity_episodes", "select site_id, opened_at, opened_occupancy, closed_at from paired where state = 1", TIMELINE)(
    lambda fx: episodes.capacity_episodes(fx.deltas, fx.capacity))

CHANGES = """
select site_id, event_time, event_id, case state when 1 then 'open' else 'resolve' end as action, occupancy from changes"""


def action_text(changes):
    return changes.select("site_id", "event_time", "event_id", F.when(F.col("mark") == 1, "open").otherwise("resolve").alias("action"), "occupancy")


query("capacity_transitions", CHANGES, TIMELINE)(lambda fx: action_text(episodes.capacity_transitions(fx.deltas, fx.capacity)))

# ----------------------------------------------------------------------------------- other replays

DAILY = {
    "days": f"""
select site_id, cast(paid_at + {IST} as date) as day, sum(amount) as revenue from payments_all group by 1, 2""",
    "day_spine": """
select s.site_id, cast(d.day as date) as day
from sites s cross join (select unnest(generate_series(min(day), max(day), INTERVAL '1 day')) as day from days) d""",
    "filled": """
select p.site_id, p.day, cast(coalesce(d.revenue, 0) * 100 as bigint) as cents
from day_spine p left join days d on d.site_id = p.site_id and d.day = p.day""",
    "weekly": "select *, lag(cents, 7) over (partition by site_id order by day) as before from filled",
    "day_marks": """
select *, case when before > 0 and cents * 100 <= before * 70 then 1 when before > 0 and cents * 100 >= before * 80 then 0 end
  as mark from weekly""",
    "history": """
select site_id, day, cents / 100.0::double as revenue, before / 100.0::double as week_before,
  case when before > 0 then
    sign(before - cents) * ((abs(before - cents) * 2000 + before) // (2 * before)) / 10.0::double end as drop_pct,
  coalesce(last_value(mark ignore nulls) over (partition by site_id order by day
    rows between unbounded preceding and current row), 0) = 1 as is_open
from day_marks""",
}
HISTORY = "select site_id, cast(day as varchar) as day, revenue, week_before, drop_pct, is_open from history"


def day_text(df, column="day"):
    """Dates as text, which both engines write alike."""
    return df.withColumn(column, F.col(column).cast("string"))


query("revenue_drop_history", HISTORY, DAILY)(
    lambda fx: day_text(episodes.revenue_drop_history(episodes.daily_revenue(fx.live_payments, fx.sites))))

query("zero_visit_history", f"""
select site_id, probe_at from (
  select s.site_id, s.opens_min, s.closes_min, epoch_ms(p.n * 1800000) as probe_at
  from sites s cross join (
    select unnest(range((min(epoch_us(checked_in)) + 7200000000 + 1799999999) // 1800000000,
                        max(epoch_us(checked_in)) // 1800000000 + 1)) as n from visits_all) p
  where s.status = 'active') q
where opens_min < date_diff('minute', date_trunc('day', probe_at + {IST}), probe_at + {IST})
  and closes_min >= date_diff('minute', date_trunc('day', probe_at + {IST}), probe_at + {IST})
  and not exists (select 1 from visits_all v where v.site_id = q.site_id
    and v.checked_in >= q.probe_at - INTERVAL '2 hours' and v.checked_in <= q.probe_at)
""")(lambda fx: episodes.zero_visit_history(fx.visits, fx.sites))
