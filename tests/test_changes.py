"""Row changes, merges, sampling, drift on hand-made rows."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sitemetrics.operators import analytics, anomalies, changes, detect, feed, quality, sampling
from sitemetrics.schemas import ANOMALIES
from sitemetrics.sources import tables
from sitemetrics.sources.store import Versions
from sitemetrics.sources.tables import Tables
from sitemetrics.streaming import runner
from tests.conftest import NOW


def test_detect_step_opens_once_and_resolves(small):
    t = Tables(small.sites, small.members, small.visits, small.payments, small.anomalies)
    after, events = detect.detect_step(t, NOW)
    rows = {(r.site_id, r.type): r for r in after.collect()}
    assert set(rows) == {(1, "zero_checkins"), (2, "capacity_breach"), (3, "revenue_drop")}
    assert rows[2, "capacity_breach"].message.endswith("Occupancy is at 100.0% (4/4).")
    assert rows[2, "capacity_breach"].severity == "critical" and rows[1, "zero_checkins"].severity == "warning"
    assert sorted(r.type for r in events.collect()) == ["ANOMALY_DETECTED"] * 3
    # A second cycle with the same state changes nothing, also when one was dismissed.
    again, none = detect.detect_step(Tables(t.sites, t.members, t.visits, t.payments,
                                            after.withColumn("dismissed", F.lit(True))), NOW + timedelta(seconds=30))
    assert again.count() == 3 and none.count() == 0
    # Everybody leaves: the breach resolves, the others stay.
    left = t.visits.withColumn("checked_out", F.coalesce("checked_out", F.lit(NOW).cast("timestamp_ntz")))
    later = Tables(t.sites, t.members, left, t.payments, after)
    final, events = detect.detect_step(later, NOW + timedelta(minutes=1))
    assert [(r.site_id, r.resolved_at) for r in final.filter("resolved").collect()] == [(2, NOW + timedelta(minutes=1))]
    assert [r.type for r in events.collect()] == ["ANOMALY_RESOLVED"]


def test_same_cycle_gives_same_ids(small):
    ids = [{r.anomaly_id for r in detect.opened(detect.actions(small, NOW), NOW).collect()} for _ in range(2)]
    assert ids[0] == ids[1] and len(ids[0]) == 3


def alert(ident, **more):
    return dict(dict(anomaly_id=ident, site_id=1, type="zero_checkins", severity="warning", message="m", resolved=False,
                     dismissed=False, detected_at=NOW), **more)


def test_upsert_is_idempotent_and_last_change_wins(make):
    current = make("anomalies", [alert("a"), alert("b")])
    batch = make("anomalies", [alert("a"), alert("a", resolved=True, resolved_at=NOW), alert("c")])
    once = anomalies.upsert(current, batch)
    twice = anomalies.upsert(once, batch)
    expect = [("a", True), ("b", False), ("c", False)]
    assert sorted((r.anomaly_id, r.resolved) for r in once.collect()) == expect
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_dismissal(spark, make, small):
    t = Tables(small.sites, small.members, small.visits, small.payments,
               make("anomalies", [alert("w"), alert("c", severity="critical")]))
    requests = spark.createDataFrame([("w",), ("c",), ("x",)], "anomaly_id string")
    updated, outcomes = anomalies.dismiss(t, requests)
    assert dict(outcomes.collect()) == {"w": "dismissed", "c": "forbidden", "x": "not_found"}
    assert {r.anomaly_id: r.dismissed for r in updated.collect()} == {"w": True, "c": False}


def test_merge_adds_unknown_ids(spark, make, small):
    t = Tables(small.sites, small.members, small.visits, small.payments, make("anomalies", [alert("a")]))
    log = anomalies.anomaly_log(t, NOW)
    done = spark.createDataFrame([("a", 1, "zero_checkins", "warning", None, NOW), ("z", 2, "revenue_drop", "warning", None, NOW)],
                                 "anomaly_id string, site_id int, type string, severity string, message string, resolved_at timestamp_ntz")
    got = {r.anomaly_id: r for r in anomalies.merge_resolved(log, done.union(done)).collect()}
    assert got["a"].resolved and got["a"].message == "m"
    assert got["z"].resolved and got["z"].message == "" and len(got) == 2


def test_log_keeps_recently_resolved(make, small):
    rows = [alert("new"), alert("edge", resolved=True, resolved_at=NOW - timedelta(hours=24)),
            alert("old", resolved=True, resolved_at=NOW - timedelta(hours=24, seconds=1)),
            alert("hidden", dismissed=True)]
    t = Tables(small.sites, small.members, small.visits, small.payments, make("anomalies", rows))
    assert {r.anomaly_id for r in anomalies.anomaly_log(t, NOW).collect()} == {"new", "edge", "hidden"}
    assert anomalies.anomaly_log(t, NOW, severity="critical").count() == 0


def test_restrict_refuses_and_cascade_follows(spark, small):
    with pytest.raises(ValueError):
        changes.delete_sites(small, spark.createDataFrame([(1,)], "site_id int"))
    gone = changes.delete_sites(small, spark.createDataFrame([(4,)], "site_id int"))
    assert gone.sites.count() == 3
    after = changes.cascade_delete(small, spark.createDataFrame([(2,)], "member_id long"))
    assert (after.members.count(), after.visits.filter("member_id = 2").count(), after.payments.count()) == (11, 0, 11)


def test_sync_keeps_or_clears_stale_values(make, small):
    kept = changes.sync_last_visit(small.members, small.visits).filter("member_id = 5").first()
    cleared = changes.sync_last_visit(small.members, small.visits, strict=True).filter("member_id = 5").first()
    assert kept.last_checkin_at is not None and cleared.last_checkin_at is None


def test_advance_never_moves_back(make, small):
    old = make("visits", [dict(visit_id=1, member_id=1, site_id=2, checked_in=datetime(2020, 1, 1))])
    assert changes.advance_last_visit(small.members, old).filter("member_id = 1").first().last_checkin_at == datetime(2024, 3, 15, 11)


def test_cohort_replacement_uses_one_cohort(small):
    cohort = sampling.random_sample(small.members.select("member_id", "site_id"), "member_id", 4, seed=7)
    new = changes.replace_cohort(small.visits, cohort, NOW, F.lit(50), F.lit(600), F.lit(60))
    ids = {r.member_id for r in cohort.collect()}
    mine = [r for r in new.collect() if r.member_id in ids]
    assert len(mine) == 4 and all(r.visit_id < 0 and (NOW - r.checked_in).days >= 49 for r in mine)
    assert all(r.checked_out - r.checked_in == timedelta(hours=1) for r in mine)


def test_payment_drift_tolerance(make, small):
    joined, due = datetime(2024, 1, 1), datetime(2024, 1, 31)
    def pay(i, kind, at):
        return dict(payment_id=i, member_id=1, site_id=2, amount=Decimal("1499.00"), plan_type="monthly", payment_type=kind, paid_at=at)
    rows = [pay(1, "new", joined + timedelta(seconds=300)), pay(2, "new", joined - timedelta(seconds=301)),
            pay(3, "renewal", due - timedelta(seconds=300)), pay(4, "renewal", due + timedelta(seconds=300, microseconds=1))]
    t = Tables(small.sites, small.members, small.visits, make("payments", rows))
    assert quality.payment_drift(t).first().asDict() == {"renewal_drift": 1, "new_drift": 1}


def test_row_numbers_split_buckets_of_any_size(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = sampling.row_numbers(rows, ["id"], ["g"], "n", "total").collect()
    for g in range(3):
        mine = sorted((r.id, r.n, r.total) for r in got if r.g == g)
        assert [n for _, n, _ in mine] == list(range(1, len(mine) + 1)) and {t for *_, t in mine} == {len(mine)}


@pytest.mark.parametrize("bound", [50_000, 0])
def test_feed_is_exact_with_ties_and_hot_sites(make, small, monkeypatch, bound):
    """With and without broadcasts."""
    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", bound)
    at = datetime(2024, 3, 1)
    visits = make("visits", [dict(visit_id=i, member_id=1 + i % 12, site_id=1 if i % 3 else 2,
                                  checked_in=at + timedelta(minutes=i // 5)) for i in range(400)])
    t = Tables(small.sites, small.members, visits, make("payments", []))
    got = sorted((r.site_id, r.id) for r in feed.activity_feed(t).collect())
    expect = []
    for site in (1, 2):
        mine = [(-(i // 5), f"{i}-in") for i in range(400) if (1 if i % 3 else 2) == site]
        expect += [(site, ident) for _, ident in sorted(mine)[:20]]
    assert got == sorted(expect)


def test_changes_of_a_cycle_merge_to_the_whole_log(spark, small, tmp_path):
    log = Versions(spark, str(tmp_path / "log"), ANOMALIES)
    t = small
    log.write(t.anomalies, log.current())
    for minutes, visits in ((0, t.visits), (30, t.visits.withColumn("checked_out", F.col("checked_in")))):
        now = NOW + timedelta(minutes=minutes)
        t = Tables(t.sites, t.members, visits, t.payments, log.read())
        whole = detect.detect_step(t, now)[0]
        anomalies.upsert_into(log, detect.detect_changes(t, now))
        assert sorted(map(str, log.read().select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert log.read().filter("resolved").count() == 1 and log.current().number == 3


def test_analytics_bundle(small):
    reports = analytics.analytics(small, NOW, "30d")
    assert list(reports) == ["peak_hours", "revenue_by_plan", "churn_risk", "member_type"]
    assert [(r.site_id, r.plan_type, r.total_revenue) for r in reports["revenue_by_plan"].collect()] == [(3, "quarterly", 31992.0)]
    assert reports["member_type"].first()["count"] == 8 and reports["churn_risk"].count() == 0
    with pytest.raises(ValueError):
        analytics.analytics(small, NOW, "180d")


def test_snapshot_is_nested_and_sorted(small):
    after, _ = detect.detect_step(small, NOW)
    t = Tables(small.sites, small.members, small.visits, small.payments, after)
    rows = {r.site_id: r for r in feed.live_snapshot(t, NOW).collect()}
    assert [e.id for e in rows[1].recent_events][:2] == ["1-out", "1-in"] and len(rows[1].recent_events) == 6
    assert (rows[2].current_occupancy, rows[2].active_anomalies[0].type) == (4, "capacity_breach")
    assert rows[4].recent_events == [] and rows[4].active_anomalies == []


def test_decode_rejects_bad_payloads(spark):
    good = ('{"type":"PAYMENT_EVENT","event_id":"1","site_id":3,"event_time":"2024-01-01T00:00:00.000001Z","member_id":4,"amount":12.50,'
            '"plan_type":"monthly","today_total":12.50}')
    bad = {"not json": "malformed", good[:-1]: "malformed", good + " x": "malformed", good + good: "malformed", good + "," + good: "malformed",
           good + "}": "malformed", "[1]": "malformed", "": "malformed", "null": "wrong type", good.replace(":3,", ':"x",'): "wrong type",
           good.replace("2024-01-01T", "yesterday "): "wrong type", good.replace(":3,", ":3.5,"): "wrong type", '{"type":"OTHER"}': "unknown type",
           "{}": "unknown type", good.replace('"member_id":4,', ""): "missing member_id", good.replace('"event_id":"1",', ""): "missing event_id",
           good.replace('"member_id":4', '"member_id":null'): "missing member_id", '{"type":"CHECKIN_EVENT"}': "missing event_id"}
    events, rejected = feed.decode(spark.createDataFrame([(p,) for p in [good, good.replace("{", '{"more":[1],', 1), None, *bad]], "payload string"))
    row = events.first()
    assert (row.event_id, row.amount, row.event_time, row.today_total) == ("1", Decimal("12.50"), datetime(2024, 1, 1, 0, 0, 0, 1), Decimal("12.50"))
    assert events.count() == 2
    assert {r.payload: r.reason for r in rejected.collect()} == {**bad, None: "malformed"}


def test_envelope_carries_running_values(small):
    rows = feed.envelope_events(small).collect()
    assert {r.type for r in rows} == {"CHECKIN_EVENT", "CHECKOUT_EVENT", "PAYMENT_EVENT"}
    assert sorted(r.current_occupancy for r in rows if r.site_id == 2 and r.type == "CHECKIN_EVENT") == [1, 2, 3, 4]
    assert max(r.capacity_pct for r in rows if r.site_id == 2 and r.capacity_pct is not None) == 100.0
    assert sorted(r.today_total for r in rows if r.site_id == 3 and r.plan_type == "quarterly")[-1] == 8 * Decimal("3999.00")
    assert {r.site_name for r in rows if r.site_id == 1} == {"Alpha zero"}


def test_accepted_and_rejected_messages_have_sinks_of_their_own(spark, small, tmp_path):
    sent = feed.encode(feed.envelope_events(small)).select("payload")
    spoiled = sent.unionByName(spark.createDataFrame([("no",), ('{"type":"PAYMENT_EVENT"}',)], "payload string"))
    spoiled.write.parquet(str(tmp_path / "in"))
    messages = runner.event_source(spark, str(tmp_path / "in"), "payload string")
    events, rejected = feed.decode(messages)
    good = runner.drain(events, str(tmp_path / "good"), str(tmp_path / "c1"))
    bad = runner.drain(rejected, str(tmp_path / "bad"), str(tmp_path / "c2"))
    assert good.count() == sent.count() and {r.reason for r in bad.collect()} == {"malformed", "missing event_id"}
