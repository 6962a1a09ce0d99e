"""Rule vectors, rounding, opening hours and zones."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitemetrics.functions import metrics, rules
from sitemetrics.functions import timeutil as tu
from sitemetrics.operators import analytics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(value, kind="long"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize("status, is_open, count, expected", [
    ("active", True, 0, True), ("active", False, 0, False), ("active", True, 5, False), ("maintenance", True, 0, False)])
def test_zero_visits(spark, status, is_open, count, expected):
    assert one(spark, rules.zero_visits_trigger(F.lit(status), F.lit(is_open), lit(count))) is expected


@pytest.mark.parametrize("occupancy, capacity, trigger, resolve, pct", [
    (275, 300, True, False, 91.7), (250, 300, False, True, 83.3), (50, 0, False, False, None),
    (50, None, False, False, None), (90, 100, False, False, 90.0), (85, 100, False, False, 85.0)])
def test_capacity(spark, occupancy, capacity, trigger, resolve, pct):
    got = one(spark, rules.capacity_flags(lit(occupancy), lit(capacity, "int")))
    assert (got.trigger, got.resolve, got.pct) == (trigger, resolve, pct)
    mark = one(spark, rules.capacity_mark(lit(occupancy), lit(capacity, "int")))
    assert mark == (1 if trigger else 0 if resolve else None)


@pytest.mark.parametrize("today, before, trigger, resolve, drop", [
    (3000, 15000, True, False, 80.0), (12500, 15000, False, True, 16.7), (5000, 0, False, False, None),
    (5000, None, False, False, None), (70, 100, True, False, 30.0), (80, 100, False, True, 20.0), (75, 100, False, False, 25.0)])
def test_revenue(spark, today, before, trigger, resolve, drop):
    got = one(spark, rules.revenue_flags(lit(today, "decimal(12,2)"), lit(before, "decimal(12,2)")))
    assert (got.trigger, got.resolve, got.drop_pct) == (trigger, resolve, drop)


def test_hysteresis_vector(spark):
    """pct 80, 91, 88, 86, 84, 88, 92 -> closed, open, open, open, closed, closed, open."""
    from pyspark.sql import Window
    rows = spark.createDataFrame(list(enumerate([80, 91, 88, 86, 84, 88, 92])), "i int, occ long")
    mark = rules.capacity_mark(F.col("occ"), F.lit(100))
    state = F.coalesce(F.last(mark, ignorenulls=True).over(Window.orderBy("i")), F.lit(0))
    assert [r.s for r in rows.withColumn("s", state).orderBy("i").collect()] == [0, 1, 1, 1, 0, 0, 1]


AS_OF = datetime(2001, 6, 1)


@pytest.mark.parametrize("last, level", [
    (AS_OF - timedelta(days=45), None), (AS_OF - timedelta(days=45, seconds=1), "HIGH"),
    (AS_OF - timedelta(days=60), "HIGH"), (AS_OF - timedelta(days=60, seconds=1), "CRITICAL"), (None, None)])
def test_churn_level(spark, last, level):
    value = F.lit(None).cast("timestamp_ntz") if last is None else tu.ts(last)
    assert one(spark, metrics.churn_level(value, AS_OF)) == level


def test_days_absent_counts_elapsed_periods(spark):
    assert one(spark, metrics.days_absent(tu.ts(datetime(2001, 5, 30, 0, 0, 1)), AS_OF)) == 1


@pytest.mark.parametrize("seconds, minutes", [(90, 2), (150, 3), (89, 1), (0, 0)])
def test_duration_rounds_half_up(spark, seconds, minutes):
    assert one(spark, metrics.duration_min(tu.ts(AS_OF), tu.ts(AS_OF + timedelta(seconds=seconds)))) == minutes


def test_contact_falls_through_empty_phone(spark):
    assert one(spark, metrics.contact(F.lit(""), F.lit("a@b"))) == "a@b"
    assert one(spark, metrics.contact(F.lit("98"), F.lit("a@b"))) == "98"


@pytest.mark.parametrize("hour, expected", [(8, 1.0), (2, 0.0), (19, 0.9)])
def test_traffic_multiplier_local_hours(spark, hour, expected):
    utc = datetime(2026, 8, 8, hour) - timedelta(minutes=330)
    assert one(spark, metrics.traffic_multiplier(tu.ts(utc))) == expected


@pytest.mark.parametrize("percent, band", [(59.9, "NORMAL"), (60.0, "BUSY"), (85.0, "BUSY"), (85.1, "CRITICAL")])
def test_bands(spark, percent, band):
    assert one(spark, metrics.occupancy_band(F.lit(percent))) == band


def test_unknown_event_and_plan(spark):
    assert one(spark, metrics.event_label(F.lit("other"))) == "IN"
    assert one(spark, metrics.plan_price(F.lit("weekly"))) == 1499


def test_local_day(spark):
    assert tu.local_midnight(datetime(2024, 1, 1, 18, 29, 59)) == datetime(2023, 12, 31, 18, 30)
    assert tu.local_midnight(datetime(2024, 1, 1, 18, 30)) == datetime(2024, 1, 1, 18, 30)
    days = [one(spark, tu.local_date(tu.ts(datetime(2024, 1, 1, 18, 29, 59)))), one(spark, tu.local_date(tu.ts(datetime(2024, 1, 1, 18, 30))))]
    assert days == [date(2024, 1, 1), date(2024, 1, 2)]


def test_local_day_with_daylight_saving():
    # 2024-03-31 has 23 hours in Berlin.
    start, end = (tu.local_midnight(datetime(2024, 3, 31, 12), "Europe/Berlin", d) for d in (0, 1))
    assert end - start == timedelta(hours=23)


@pytest.mark.parametrize("minute, detector, inclusive, half_open", [
    (360, False, True, True), (361, True, True, True), (1320, True, True, False), (1321, False, False, False)])
def test_opening_minutes(spark, minute, detector, inclusive, half_open):
    as_of = datetime(2024, 1, 1) - timedelta(minutes=330) + timedelta(minutes=minute)
    got = [one(spark, tu.is_open(as_of, F.lit(360), F.lit(1320), mode=m)) for m in ("detector", "inclusive", "half_open")]
    assert got == [detector, inclusive, half_open]


def test_inclusive_hours_compare_seconds(spark):
    as_of = datetime(2024, 1, 1, 16, 30, 1)   # 22:00:01 local
    assert one(spark, tu.is_open(as_of, F.lit(360), F.lit(1320), mode="inclusive")) is False


def test_unknown_mode_and_range_rejected():
    with pytest.raises(ValueError):
        tu.is_open(AS_OF, None, None, mode="other")
    with pytest.raises(ValueError):
        analytics.range_days("180d")
