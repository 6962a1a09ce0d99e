"""Typed reads, defaults, partition pruning, rewinding."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitemetrics import schemas
from sitemetrics.functions import timeutil as tu
from sitemetrics.operators import detect, feed, live
from sitemetrics.sources import tables
from tests.conftest import NOW


def partition_filters(df):
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def test_round_trip_and_pruning(spark, small, tmp_path):
    folder = str(tmp_path / "t")
    tables.write_tables(small, folder)
    back = tables.read_tables(spark, folder)
    for name, schema in schemas.TABLES.items():
        got = getattr(back, name).select(*schema.fieldNames())
        assert [f.dataType for f in got.schema] == [f.dataType for f in schema]
        assert sorted(map(str, got.collect())) == sorted(map(str, getattr(small, name).collect()))
    assert any("local_date" in f for f in partition_filters(live.recent_visit_count(back, NOW)))
    assert any("is_open" in f for f in partition_filters(live.live_occupancy(back)))
    assert live.live_occupancy(back).orderBy("site_id").collect() == live.live_occupancy(small).orderBy("site_id").collect()
    assert live.site_overview(back, NOW).collect() == live.site_overview(small, NOW).collect()
    for run in (feed.activity_feed, lambda t: detect.actions(t, NOW), lambda t: live.open_visits_enriched(t.rewind(NOW))):
        assert sorted(map(str, run(back).collect())) == sorted(map(str, run(small).collect()))


def test_defaults_fill_nulls(spark, make):
    row = tables.with_defaults(make("sites", [dict(site_id=1, name="a", city="c", capacity=3)]), "sites").first()
    assert (row.status, row.opens_min, row.closes_min) == ("active", 360, 1320)
    row = tables.with_defaults(make("anomalies", [dict(anomaly_id="a")]), "anomalies").first()
    assert (row.resolved, row.dismissed) == (False, False)


def test_seed_guard(small, make):
    assert tables.is_seeded(small)
    assert not tables.is_seeded(tables.Tables(make("sites", []), None, None, None))


def test_rewind(make):
    t0 = datetime(2024, 1, 1, 12)
    visits = make("visits", [dict(visit_id=1, site_id=1, checked_in=t0, checked_out=t0 + timedelta(hours=1)),
                             dict(visit_id=2, site_id=1, checked_in=t0 + timedelta(hours=2))])
    anomalies = make("anomalies", [dict(anomaly_id="a", resolved=True, detected_at=t0, resolved_at=t0 + timedelta(hours=3))])
    t = tables.Tables(make("sites", []), make("members", []), visits, make("payments", []), anomalies)
    early = t.rewind(t0 + timedelta(minutes=30))
    assert [(r.visit_id, r.checked_out) for r in early.visits.collect()] == [(1, None)]
    assert [(r.resolved, r.resolved_at) for r in early.anomalies.collect()] == [(False, None)]
    late = t.rewind(t0 + timedelta(hours=4))
    assert late.anomalies.first().resolved and late.visits.count() == 2


def test_sites_beyond_the_bound_are_not_broadcast(small, monkeypatch):
    expected = live.open_visits_enriched(small).orderBy("visit_id").collect()
    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", 0)
    wide = tables.Tables(small.sites, small.members, small.visits, small.payments, small.anomalies)
    df = live.open_visits_enriched(wide)
    assert "ResolvedHint (strategy=broadcast)" not in df._jdf.queryExecution().analyzed().toString()
    assert df.orderBy("visit_id").collect() == expected


def test_window_bounds_are_half_open(make):
    lo, hi = datetime(2024, 1, 1), datetime(2024, 1, 2)
    df = make("payments", [dict(payment_id=i, paid_at=t) for i, t in enumerate([lo - timedelta(microseconds=1), lo, hi])])
    assert [r.payment_id for r in tu.within(df, "paid_at", lo, hi).select(F.col("payment_id")).collect()] == [1]
