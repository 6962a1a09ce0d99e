"""The feed's cut by dates: exact, one path for any number of sites, pruned on stored tables."""

import random
import re
from dataclasses import replace
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from sitemetrics.operators import feed
from sitemetrics.sources import tables

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def wide(make, small):
    """A busy site, a site of long visits, one of few events, and rows without a site."""
    rng = random.Random(3)
    visits = []
    for i in range(400):
        site = (1, 1, 1, 2, 3, None)[i % 6] if i % 25 else 4
        start = T0 + timedelta(minutes=rng.randrange(60 * 24 * 60))
        stay = timedelta(minutes=rng.choice([30, 60, 60 * 24 * 20 if site == 2 else 90]))
        visits.append(dict(visit_id=i, member_id=1 + i % 12, site_id=site, checked_in=start, checked_out=start + stay if i % 7 else None))
    payments = [dict(payment_id=1000 + i, member_id=1, site_id=1 + i % 3, amount=Decimal("5.00"), plan_type="monthly", payment_type="new",
                     paid_at=T0 + timedelta(hours=11 * i)) for i in range(100)]
    return replace(small, visits=make("visits", visits), payments=make("payments", payments))


@pytest.mark.parametrize("n", [1, 5, 20, 500])
def test_cut_is_exact(wide, n):
    assert rows(feed.newest(feed.feed_events(feed.recent_enough(wide, n)), n)) == rows(feed.newest(feed.feed_events(wide), n))


def test_one_path_for_any_number_of_sites(wide, monkeypatch):
    expected = rows(feed.activity_feed(wide))
    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", 0)
    many = replace(wide)
    df = feed.activity_feed(many)
    assert "ResolvedHint (strategy=broadcast)" not in df._jdf.queryExecution().analyzed().toString()
    assert rows(df) == expected


def test_stored_tables_are_pruned(spark, wide, tmp_path):
    folder = str(tmp_path / "t")
    early = replace(wide, visits=wide.visits.filter("visit_id < 300"))
    tables.write_tables(early, folder)
    back = tables.read_tables(spark, folder)
    df = feed.activity_feed(back, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning[^\]]*\]", plan)
    assert rows(df) == rows(feed.activity_feed(early, 3))
    tables.append_facts(tables.Tables(None, None, wide.visits.filter("visit_id >= 300"), wide.payments.limit(0)), folder)
    again = tables.read_tables(spark, folder)
    assert rows(feed.activity_feed(again, 3)) == rows(feed.activity_feed(wide, 3))
    assert rows(feed.merged_days(again.activity)) == rows(feed.activity_days(wide))
