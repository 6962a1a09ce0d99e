"""The window form of the replay against a step-by-step state machine."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitemetrics.operators import episodes

T0 = datetime(2024, 1, 1)
CAPACITY = 5


def machine(rows):
    """rows: (site, time, id, delta) -> {site: [(time, id, occupancy, state change or None)]}."""
    out, occupancy, is_open = [], {}, {}
    for site, at, ident, delta in sorted(rows):
        occ = occupancy[site] = max(0, occupancy.get(site, 0) + delta)
        change = None
        if occ * 100 > CAPACITY * 90 and not is_open.get(site):
            is_open[site], change = True, 1
        elif occ * 100 < CAPACITY * 85 and is_open.get(site):
            is_open[site], change = False, 0
        out.append((site, at, ident, occ, change))
    return out


# Every site is an independent history, so one example checks many.
SITES = range(1, 41)
events = st.lists(st.tuples(st.sampled_from(SITES), st.integers(0, 600), st.sampled_from([1, 1, -1])), min_size=1, max_size=800)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events)
def test_replay_equals_state_machine(spark, drawn):
    rows = [(site, T0 + timedelta(minutes=m), i, delta) for i, (site, m, delta) in enumerate(drawn)]
    df = spark.createDataFrame(rows, "site_id int, event_time timestamp_ntz, event_id long, delta int").coalesce(1)
    expected = machine(rows)
    timeline = episodes.occupancy_timeline(df, timedelta(minutes=45)).collect()
    assert sorted((r.site_id, r.event_time, r.event_id, r.occupancy) for r in timeline) == sorted(e[:4] for e in expected)
    capacity = spark.createDataFrame([(s, CAPACITY) for s in SITES], "site_id int, capacity int")
    got = episodes.capacity_transitions(df, capacity, timedelta(minutes=45)).collect()
    changes = [e for e in expected if e[4] is not None]
    assert sorted((r.site_id, r.event_time, r.event_id, r.occupancy, r.mark) for r in got) == sorted(changes)
    found = episodes.capacity_episodes(df, capacity, timedelta(minutes=45)).collect()
    pairs = []
    for site in SITES:
        mine = [c for c in changes if c[0] == site]
        pairs += [(site, c[1], mine[i + 1][1] if i + 1 < len(mine) else None) for i, c in enumerate(mine) if c[4] == 1]
    assert sorted(map(str, ((r.site_id, r.opened_at, r.closed_at) for r in found))) == sorted(map(str, pairs))


    # Folded in two drains with the state stored in between.
    cut_at = T0 + timedelta(minutes=300)
    stored = spark.createDataFrame([], episodes.CAPACITY_STATE)
    folded = []
    for part in (df.filter(F.col("event_time") < F.lit(cut_at).cast("timestamp_ntz")),
                 df.filter(F.col("event_time") >= F.lit(cut_at).cast("timestamp_ntz"))):
        new, stored = episodes.capacity_advance(stored, part, capacity, timedelta(minutes=45))
        folded += [(r.site_id, r.event_time, r.event_id, r.occupancy, r.mark) for r in new.collect()]
    assert sorted(folded) == sorted(changes)


def test_zero_visits_bounds(spark, make):
    """A visit exactly two hours before the probe, or at the probe, still counts."""
    site = dict(site_id=1, name="a", city="x", status="active", capacity=1, opens_min=0, closes_min=1439)
    noon = datetime(2024, 1, 1, 12)
    visits = make("visits", [dict(visit_id=i, member_id=1, site_id=1, checked_in=noon + timedelta(minutes=m))
                             for i, m in enumerate([0, 330])])
    got = episodes.zero_visit_history(visits, make("sites", [site])).collect()
    assert [r.probe_at for r in sorted(got)] == [noon + timedelta(minutes=m) for m in (150, 180, 210, 240, 270, 300)]


def test_revenue_history_of_zero_filled_days(spark, make):
    from decimal import Decimal
    pay = [dict(payment_id=d, member_id=1, site_id=1, amount=Decimal("100.00"), paid_at=datetime(2024, 1, 1, 6) + timedelta(days=d))
           for d in range(7)]
    pay.append(dict(pay[0], payment_id=99, amount=Decimal("80.00"), paid_at=datetime(2024, 1, 9, 6)))
    sites = make("sites", [dict(site_id=1, name="a")])
    got = episodes.revenue_drop_history(episodes.daily_revenue(make("payments", pay), sites)).orderBy("day").collect()
    assert [(r.revenue, r.week_before, r.is_open) for r in got[6:]] == [(100.0, None, False), (0.0, 100.0, True), (80.0, 100.0, False)]


def test_detect_blocks_are_fixed_times(spark):
    df = spark.createDataFrame([(1, T0, 1, 1), (1, T0 + timedelta(minutes=15), 2, 1)],
                               "site_id int, event_time timestamp_ntz, event_id long, delta int")
    blocks = [r.block for r in episodes.occupancy_timeline(df).orderBy("event_id").select("block").collect()]
    assert blocks[1] == blocks[0] + 1
    assert episodes.occupancy_timeline(df).agg(F.max("occupancy")).first()[0] == 2
