"""Folds over logs: any order of arrival, late slices, repeated folding."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitemetrics.operators import episodes, feed
from sitemetrics.plans.registry import fixture
from sitemetrics.sources.store import Versions
from sitemetrics.streaming import capacity, jobs, runner, totals

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def fx(spark):
    return fixture(spark, "/root/testdata/sf0.001")


def rows(df):
    return sorted(map(str, df.collect()))


def test_late_slice_changes_the_totals_and_folding_twice_does_not(spark, fx, tmp_path):
    inbox, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    fold = None
    for k in fx.deliveries(inbox, (0, 1, 3, 2)):
        stream = totals.ledger(fx.event_stream(inbox))
        runner.drain(stream, sink, str(tmp_path / "checkpoint"))
        fold = fold or totals.Fold(totals.Log(spark, sink, stream.schema), Versions(spark, str(tmp_path / "v"), totals.PARTIALS), totals.quarters, totals.summed)
        if k == 3:
            early = rows(fold.read())
            one = fold.advance()
            assert fold.advance() == one and rows(fold.read()) == early
    late = rows(fold.read())
    assert late != early
    assert rows(fold.versions.read()) == early   # the snapshot has not moved yet
    fold.advance()
    assert rows(fold.versions.read()) == late
    moves = fx.deltas.groupBy("site_id").agg(F.sum("delta").alias("current_occupancy"))
    assert rows(totals.occupancy(fold.read(), fx.sites).filter("current_occupancy <> 0")) == rows(moves.filter("current_occupancy <> 0"))
    days = episodes.daily_revenue(fx.live_payments, fx.sites).filter("revenue > 0")
    assert rows(totals.revenue_by_day(fold.read())) == rows(days)


def test_feed_top_is_independent_of_order_and_repeats(spark, fx, tmp_path):
    expected = sorted((r.site_id, r.id) for r in feed.newest(feed.feed_events(fx.all)).collect())
    inbox, sink, folds = str(tmp_path / "in"), str(tmp_path / "sink"), []
    for _ in fx.deliveries(inbox, (3, 1, 0, 2, 3)):
        stream = jobs.feed_stream(fx.event_stream(inbox))
        runner.drain(stream, sink, str(tmp_path / "checkpoint"))
        if not folds:
            folds.append(totals.Fold(totals.Log(spark, sink, stream.schema), Versions(spark, str(tmp_path / "v"), stream.schema), lambda r: r, totals.top_of_each_site()))
        folds[0].advance()
    assert sorted((r.site_id, r.id) for r in folds[0].read().collect()) == expected
    assert folds[0].versions.current().rows == len(expected)


@pytest.mark.parametrize("last", [0, 1, 2, 3])
def test_capacity_equals_the_replay_whichever_slice_comes_last(spark, tmp_path, last):
    rng = random.Random(last)
    drawn = [(site, T0 + timedelta(minutes=rng.randrange(600)), f"{i:04d}", rng.choice([1, 1, -1])) for i, site in enumerate(rng.choices(range(1, 9), k=400))]
    schema = "site_id int, event_time timestamp_ntz, event_id string, delta int"
    moves = spark.createDataFrame(drawn, schema)
    limits = spark.createDataFrame([(s, 5) for s in range(1, 9)], "site_id int, capacity int")
    sink, block = str(tmp_path / "log"), timedelta(minutes=45)
    fold = capacity.CapacityFold(totals.Log(spark, sink, moves.schema), Versions(spark, str(tmp_path / "v"), capacity.STATE), limits, block)
    for k in [*(k for k in range(4) if k != last), last]:
        at = F.floor(totals.tu.micros(F.col("event_time")) / 1_000_000 - int((T0 - datetime(1970, 1, 1)).total_seconds())) / (150 * 60)
        moves.filter(F.floor(at) == k).coalesce(1).write.mode("append").parquet(sink)
        fold.advance()
    again = fold.advance()
    assert again == fold.versions.current()
    expected = episodes.capacity_transitions(moves, limits, block).select("site_id", "event_time", "event_id", "occupancy", "mark")
    assert rows(fold.transitions().select(*expected.columns)) == rows(expected) and expected.count() > 10
    assert not any("array" in t for _, t in fold.versions.read().dtypes)


def test_panes_give_the_windows(spark, make):
    site = dict(city="x", status="active", capacity=1, opens_min=0, closes_min=1439)
    sites = make("sites", [dict(site, site_id=1, name="a"), dict(site, site_id=2, name="b"), dict(site, site_id=3, name="c", status="maintenance")])
    events = spark.createDataFrame([(1, "in", T0 + timedelta(minutes=m)) for m in (0, 29, 300)] + [(1, "out", T0 + timedelta(minutes=100))],
                                   "site_id int, kind string, event_time timestamp_ntz")
    parts = totals.summed_panes(totals.panes(events.filter("minute(event_time) < 15")).unionByName(totals.panes(events.filter("minute(event_time) >= 15"))))
    got = {(r.site_id, int((r.window_end - T0).total_seconds()) // 60) for r in totals.silent_windows(parts, sites).collect()}
    ends = range(30, 331, 30)
    assert got == {(1, e) for e in ends if not any(e - 120 <= m < e for m in (0, 29, 300))} | {(2, e) for e in ends if e + 330 != 1440}
    assert totals.silent_windows(parts.limit(0), sites).count() == 0


def test_capacity_replay_has_no_row_exchange_on_sites(spark, fx):
    """Rows are dealt by (site, block); only the one-row summaries meet sites."""
    import re
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks = episodes.chained(episodes.summaries(episodes.steps(fx.deltas)))
        plan = episodes.marked_runs(episodes.steps(fx.deltas), blocks, fx.capacity)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for line in re.findall(r"Exchange hashpartitioning\(site_id#\d+, \d+\).*", plan):
        assert "event_time" not in line
    assert re.search(r"Exchange hashpartitioning\(site_id#\d+, block#\d+L", plan)
