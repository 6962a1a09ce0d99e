"""Registered queries: row changes, samples, cohorts, spines."""

from datetime import date, datetime, timedelta
from uuid import uuid4

from pyspark.sql import functions as F

from sitemetrics.operators import changes, sampling, spines
from sitemetrics.plans.fixture_sql import DAY, NOW
from sitemetrics.plans.registry import query
from sitemetrics.session import shared_dir
from sitemetrics.sources.fixtures import AS_OF
from sitemetrics.sources.visits import VisitLog

# ------------------------------------------------------------------------------------- row changes

_LAST = {"last": "select member_id, max(checked_in) as last_at from visits_all group by member_id"}
query("last_visit", "select * from last", _LAST)(lambda fx: changes.last_visit(fx.visits))

query("last_visit_mismatch", """
select m.member_id, m.last_checkin_at, l.last_at from members_live m left join last l on l.member_id = m.member_id
where m.last_checkin_at is distinct from l.last_at""", _LAST)(lambda fx: changes.last_visit_mismatch(fx.all))

query("sync_last_visit", """
select m.member_id, coalesce(l.last_at, m.last_checkin_at) as last_checkin_at
from members_live m left join last l on l.member_id = m.member_id""", _LAST)(
    lambda fx: changes.sync_last_visit(fx.live_members, fx.visits).select("member_id", "last_checkin_at"))

def visit_log(fx, name):
    """The visits of the live clock as a log: openings, then closings, the first ten days compacted in between."""
    log = VisitLog(fx.spark, f"{shared_dir(fx.spark)}/{name}-{uuid4().hex}")
    log.open(fx.visits)
    ends = fx.visits.filter("checked_out is not null").select("visit_id", "checked_in", F.col("checked_out").alias("closed_at"))
    log.close(ends.filter("visit_id % 2 = 0"))
    log.compact([date(2024, 1, d) for d in range(1, 4)])
    log.close(ends.filter("visit_id % 2 = 1"))
    return log


# Visits open for more than a day are closed 90 minutes after they began.
@query("close_visits", f"""
select visit_id, member_id, site_id, checked_in, case when checked_out is null and checked_in < {NOW} - INTERVAL '1 day'
  then checked_in + INTERVAL '90 minutes' else checked_out end as checked_out from visits
""")
def close_visits(fx):
    log = visit_log(fx, "close")
    stale = log.read(AS_OF).filter(F.col("checked_out").isNull() & (F.col("checked_in") < F.lit(AS_OF - timedelta(days=1)).cast("timestamp_ntz")))
    log.close(stale.select("visit_id", "checked_in", (F.col("checked_in") + F.expr("interval 90 minutes")).alias("closed_at")))
    return log.read(AS_OF).drop("local_date")


query("visits_as_of", """
select visit_id, member_id, site_id, checked_in, case when checked_out <= TIMESTAMP '2024-01-15 07:30:00' then checked_out end as checked_out
from visits_all where checked_in <= TIMESTAMP '2024-01-15 07:30:00'""")(
    lambda fx: visit_log(fx, "rewind").read(datetime(2024, 1, 15, 7, 30)).drop("local_date"))

query("reset_baseline", """
select m.member_id, coalesce(l.last_at, m.last_checkin_at) as last_checkin_at
from members_live m left join (select member_id, max(checked_in) as last_at from visits where checked_out is not null
  group by member_id) l on l.member_id = m.member_id""")(
    lambda fx: changes.reset_baseline(fx.live)[1].select("member_id", "last_checkin_at"))
query("reset_baseline_visits", "select * from visits where checked_out is not null")(
    lambda fx: changes.reset_baseline(fx.live)[0])

query("windowed_delete", f"""
select * from visits where not (site_id in (3) and checked_in >= {NOW} - INTERVAL '3 hours')
""")(lambda fx: changes.windowed_delete(fx.live.visits, "checked_in", AS_OF - timedelta(hours=3), [3]))

query("cascade_delete", """
select 'members' as table_name, member_id as id from members where status <> 'inactive'
union all select 'visits', visit_id from visits_all
  where member_id not in (select member_id from members where status = 'inactive')
union all select 'payments', payment_id from payments_all
  where member_id not in (select member_id from members where status = 'inactive')""")(
    lambda fx: _ids(changes.cascade_delete(fx.all, fx.members.filter("status = 'inactive'"))))


def _ids(t):
    parts = [t.members.select(F.lit("members").alias("table_name"), F.col("member_id").alias("id")),
             t.visits.select(F.lit("visits"), "visit_id"), t.payments.select(F.lit("payments"), "payment_id")]
    return parts[0].union(parts[1]).union(parts[2])


# ----------------------------------------------------------------------------- samples and cohorts

HIGH, CRITICAL, SEED = 150, 80, 42
_COHORTS = {
    "high_risk": f"""
select member_id, site_id from members where status = 'active'
order by md5('{SEED}:' || cast(member_id as varchar)), member_id limit {HIGH}""",
    "critical_risk": f"""
select member_id, site_id from members where status = 'active' and member_id not in (select member_id from high_risk)
order by md5('{SEED + 1}:' || cast(member_id as varchar)), member_id limit {CRITICAL}""",
    "strata": f"""
select member_id, site_id, cast(row_number() over (partition by site_id
  order by md5('{SEED}:' || cast(member_id as varchar)), member_id) as integer) as rn from members where status = 'active'""",
}
query("random_sample", "select * from high_risk", _COHORTS)(
    lambda fx: sampling.churn_cohorts(fx.members, HIGH, CRITICAL, SEED)[0])
query("cohort_exclusion", "select * from critical_risk", _COHORTS)(
    lambda fx: sampling.churn_cohorts(fx.members, HIGH, CRITICAL, SEED)[1])
query("cohort_union", "select member_id from high_risk union select member_id from critical_risk", _COHORTS)(
    lambda fx: sampling.cohort_union(*sampling.churn_cohorts(fx.members, HIGH, CRITICAL, SEED)))
query("stratified_sample", "select * from strata where rn <= 4", _COHORTS)(
    lambda fx: sampling.stratified_sample(fx.members.filter("status = 'active'").select("member_id", "site_id"),
                                          "member_id", 4, SEED))
query("tiered_sample", """
select t.member_id, t.site_id, t.rn from strata t join sites s on s.site_id = t.site_id
where t.rn <= case when s.capacity >= 100 then 8 when s.capacity >= 80 then 5 else 3 end""", _COHORTS)(
    lambda fx: sampling.tiered_sample(fx.ledger, [(100, 8), (80, 5)], 3, SEED))

query("cohort_replace", f"""
select visit_id, member_id, site_id, checked_in, checked_out from visits
where member_id not in (select member_id from high_risk)
union all
select -member_id - 1, member_id, site_id, start_at, start_at + (45 + member_id % 46) * INTERVAL '1 minute'
from (select *, {DAY} - (46 + member_id % 12) * INTERVAL '1 day' + (600 + member_id % 60) * INTERVAL '1 minute' as start_at
  from high_risk) q""", _COHORTS)(
    lambda fx: changes.replace_cohort(
        fx.live.visits, sampling.churn_cohorts(fx.members, HIGH, CRITICAL, SEED)[0], AS_OF,
        (F.col("member_id") % 12 + 46).cast("int"), (F.col("member_id") % 60 + 600).cast("int"),
        (F.col("member_id") % 46 + 45).cast("int")))

query("numbered_checks", """
select 'M-' || row_number() over (order by s.name) as test_id, s.name, count(m.member_id) as members
from sites s left join members m on m.site_id = s.site_id group by s.name""")(
    lambda fx: sampling.row_numbers(
        fx.sites.join(fx.members.groupBy("site_id").agg(F.count(F.lit(1)).alias("members")), "site_id", "left"), ["name"]).select(
        F.concat(F.lit("M-"), F.col("rn")).alias("test_id"), "name", F.coalesce("members", F.lit(0)).alias("members")))

query("member_contact_keys", """
select member_id, number, lower(name) || '.' || lpad(cast(number as varchar), 9, '0') as contact_key
from (select member_id, name, row_number() over (order by site_id, member_id) as number from members) q""")(
    lambda fx: sampling.numbered_members(fx.members))

query("quota_cohorts", """
select member_id, site_id, seq, case when seq::double / n <= 0.4::double then 'monthly'
  when seq::double / n <= 0.8::double then 'quarterly' else 'annual' end as cohort
from (select member_id, site_id, row_number() over (partition by site_id order by member_id) as seq,
  count(*) over (partition by site_id) as n from members) q""")(
    lambda fx: sampling.quota_cohorts(fx.members, [(0.4, "monthly"), (0.8, "quarterly")], "annual"))

# ------------------------------------------------------------------------------------------ spines

_HOURS = {"open_hours": """
select s.site_id, cast(h.h as integer) as hour from sites s join range(24) h(h)
on h.h * 60 < s.closes_min and (h.h + 1) * 60 > s.opens_min"""}
query("site_open_hours", "select * from open_hours", _HOURS)(lambda fx: spines.site_open_hours(fx.sites))
query("hour_pool", """
select site_id, string_agg(cast(hour as varchar), ',' order by hour) as hours
from (select site_id, hour, unnest(range(case when hour < 5 or hour = 23 then 0 when hour = 5 then 30 when hour = 6 then 60
  when hour < 10 then 100 when hour < 12 then 40 when hour < 14 then 30 when hour < 17 then 20 when hour < 21 then 90
  else 35 end)) as copy from open_hours) q group by site_id""", _HOURS)(
    lambda fx: spines.hour_pool(fx.sites).select("site_id", F.array_join("hours", ",").alias("hours")))
query("member_day_spine", """
select m.member_id, m.site_id, cast(cast(d.d as date) as varchar) as day,
  case extract(dow from d.d) when 0 then 0.45::double when 1 then 1.0 when 2 then 0.95 when 3 then 0.9 when 4 then 0.95
    when 5 then 0.85 else 0.7 end as weight
from members m cross join generate_series(timestamp '2001-03-03', timestamp '2001-05-31', interval '1 day') d(d)
where m.status = 'active'""")(
    lambda fx: spines.member_day_spine(fx.members, date(2001, 3, 3), date(2001, 5, 31)).withColumn(
        "day", F.col("day").cast("string")))
