"""Registered queries: the streaming jobs over the event table.

The table arrives in four time slices, the third of them last, so each drain meets rows older than those before. Results cover all events.
"""

from pyspark.sql import functions as F

from sitemetrics.plans.fixture_sql import IST
from sitemetrics.plans.history import CHANGES, DAILY, HISTORY, TIMELINE, action_text, day_text
from sitemetrics.plans.registry import query
from sitemetrics.sources.store import Versions
from sitemetrics.streaming import capacity, jobs, runner, totals

MOVES = {
    "moves": """
select site_id, member_id, cast(visit_id as varchar) || '-in' as event_id, 'in' as kind, checked_in as event_time, 1 as delta
from visits_all
union all select site_id, member_id, cast(visit_id as varchar) || '-out', 'out', checked_out, -1
from visits_all where checked_out is not null""",
    "stream_occ": """
select s.site_id, cast(coalesce(sum(m.delta), 0) as bigint) as current_occupancy
from sites s left join moves m on m.site_id = s.site_id group by s.site_id""",
    "stream_days": f"""
select site_id, cast(paid_at + {IST} as date) as day, sum(amount) as revenue from payments_all group by 1, 2""",
}


def drain(fx, name, stream, partition_by=None):
    sink, checkpoint = runner.fresh_run(fx.spark, name)
    return runner.drain(stream, sink, checkpoint, partition_by)


def folded(fx, name, part, make, order=(0, 1, 3, 2), advance_after=2):
    """The fold `make(log, versions folder)` after all slices were drained one by one; it advances after `advance_after` of them."""
    sink, checkpoint = runner.fresh_run(fx.spark, name)
    root = sink.rsplit("/", 1)[0]
    stream, fold = None, None
    for i, _ in enumerate(fx.deliveries(f"{root}/inbox", order)):
        if stream is None:
            stream = part(fx.event_stream(f"{root}/inbox"))
            fold = make(totals.Log(fx.spark, sink, stream.schema), f"{root}/versions")
        runner.drain(stream, sink, checkpoint)
        if i + 1 == advance_after:
            fold.advance()
    return fold


def current_totals(fx):
    """Net moves and revenue per site and quarter: a snapshot of two slices and the two that came after it."""
    return folded(fx, "totals", totals.ledger, lambda log, root: totals.Fold(
        log, Versions(fx.spark, root, totals.PARTIALS), totals.quarters, totals.summed)).read()


def wall_clock(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


query("stream_occupancy", "select * from stream_occ", MOVES)(lambda fx: totals.occupancy(current_totals(fx), fx.sites))

query("stream_daily_revenue", """
select site_id, cast(day as varchar) as day, cast(revenue as double) as revenue from stream_days""", MOVES)(
    lambda fx: day_text(totals.revenue_by_day(current_totals(fx))).withColumn("revenue", F.col("revenue").cast("double")))


@query("stream_fleet_summary", """
select cast(sum(o.current_occupancy) as bigint) as total_occupancy, cast(coalesce(sum(d.revenue), 0) as double) as total_revenue
from stream_occ o left join stream_days d on d.site_id = o.site_id and d.day = (select max(day) from stream_days)""", MOVES)
def stream_fleet_summary(fx):
    """Fleet totals on the newest local day."""
    parts = current_totals(fx)
    newest = totals.revenue_by_day(parts).agg(F.max("day")).first()[0]
    return totals.fleet_totals(totals.fleet_state(parts, fx.sites, newest))


query("stream_revenue_drop", HISTORY, {**MOVES, **DAILY, "days": "select * from stream_days"})(
    lambda fx: day_text(totals.revenue_drops(current_totals(fx), fx.sites)))


@query("stream_feed", """
select site_id, id, event_type, member_id, event_time, cast(amount as double) as amount, plan_type
from (select *, row_number() over (partition by site_id order by event_time desc, id) as rn from (
    select site_id, event_id as id, case kind when 'in' then 'checkin' else 'checkout' end as event_type, member_id,
      event_time, cast(null as decimal(12,2)) as amount, cast(null as varchar) as plan_type from moves
    union all
    select site_id, cast(payment_id as varchar), 'payment', member_id, paid_at, amount, plan_type from payments_all) e) q
where rn <= 20""", MOVES)
def stream_feed(fx):
    """The stored newest 20 of each site, moved on after three slices; one slice is late and one comes twice."""
    top = folded(fx, "feed", jobs.feed_stream, lambda log, root: totals.Fold(
        log, Versions(fx.spark, root, log.schema), lambda rows: rows, totals.top_of_each_site()), (0, 1, 3, 2, 1), 3).read()
    return wall_clock(top, "event_time").withColumn("amount", F.col("amount").cast("double"))


@query("stream_zero_visits", f"""
select site_id, window_end from (
  select s.site_id, s.opens_min, s.closes_min, w.window_end from sites s cross join windows w where s.status = 'active') q
where opens_min < date_diff('minute', date_trunc('day', window_end + {IST}), window_end + {IST})
  and closes_min >= date_diff('minute', date_trunc('day', window_end + {IST}), window_end + {IST})
  and not exists (select 1 from visits_all v where v.site_id = q.site_id
    and v.checked_in >= q.window_end - INTERVAL '2 hours' and v.checked_in < q.window_end)""", {
    "panes": "select time_bucket(INTERVAL '30 minutes', checked_in) + INTERVAL '30 minutes' as pane_end from visits_all",
    "windows": "select unnest(generate_series(min(pane_end), max(pane_end), INTERVAL '30 minutes')) as window_end from panes",
})
def stream_zero_visits(fx):
    fold = folded(fx, "zero", totals.ledger, lambda log, root: totals.Fold(
        log, Versions(fx.spark, root, totals.PANES), totals.panes, totals.summed_panes))
    return totals.silent_windows(fold.read(), fx.sites)


def capacity_changes(fx, name, order, advance_after):
    fold = folded(fx, name, capacity.moves, lambda log, root: capacity.CapacityFold(
        log, Versions(fx.spark, root, capacity.STATE), fx.capacity), order, advance_after)
    fold.advance()
    return action_text(fold.transitions())


query("stream_capacity_events", CHANGES, TIMELINE)(lambda fx: capacity_changes(fx, "capacity", (0, 1, 2, 3), 0))
# The second quarter of the rows comes last, when the state of all others is stored.
query("stream_capacity_fold", CHANGES, TIMELINE)(lambda fx: capacity_changes(fx, "late", (0, 2, 3, 1), 3))

_ERRORS = {"alerts": """
select event_id, site_id, type, ts, event_id % 20 <> 0 as resolved, ts + (event_id % 60 + 5) * INTERVAL '1 minute' as resolved_at
from errors"""}
query("stream_anomaly_log", """
select cast(event_id as varchar) as anomaly_id, site_id, type,
  case type when 'capacity_breach' then 'critical' else 'warning' end as severity,
  type || ' #' || event_id as message, case when resolved then resolved_at end as resolved_at, resolved from alerts""", _ERRORS)(
    lambda fx: jobs.anomaly_lists(drain(fx, "alerts", jobs.anomaly_stream(fx.event_stream()))))


@query("stream_dedup", "select site_id, event_id, kind from moves", MOVES)
def stream_dedup(fx):
    """Every move is sent twice; the sink holds it once."""
    twice = (fx.event_stream().filter(F.col("kind").isin("in", "out"))
             .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("copy"))
    return drain(fx, "dedup", jobs.deduplicated(twice).select("site_id", "event_id", "kind"))


query("stream_enriched", """
select m.event_id, m.kind, m.site_id, m.member_id, c.name as member_name, s.capacity, m.event_time
from moves m join sites s on s.site_id = m.site_id join members c on c.member_id = m.member_id""", MOVES)(
    lambda fx: wall_clock(drain(fx, "enriched", jobs.enriched(fx.event_stream(), fx.all)), "event_time"))

query("append_events", f"""
select event_id, kind, site_id, event_time, cast(cast(event_time + {IST} as date) as varchar) as local_date
from moves where kind = 'in'
union all select cast(payment_id as varchar), 'payment', site_id, paid_at, cast(cast(paid_at + {IST} as date) as varchar)
from payments_all""",
      MOVES)(lambda fx: day_text(wall_clock(drain(fx, "append", jobs.visits_to_append(fx.event_stream()), "local_date"),
                                            "event_time"), "local_date").select("event_id", "kind", "site_id", "event_time", "local_date"))
