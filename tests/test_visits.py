"""Opening and closing logs, compaction, the stored heatmap, numbering."""

import os
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitemetrics.operators import analytics, sampling
from sitemetrics.sources import loads
from sitemetrics.sources.store import Versions
from sitemetrics.sources.visits import VisitLog

T0 = datetime(2024, 1, 1, 6)


def rows(df):
    return sorted(map(str, df.collect()))


def partition_filters(df):
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def visits(make):
    return make("visits", [dict(visit_id=i, member_id=i % 7, site_id=i % 3, checked_in=T0 + timedelta(hours=7 * i),
                                checked_out=T0 + timedelta(hours=7 * i + i % 40) if i % 4 else None) for i in range(40)])


def ends(visits):
    return visits.filter("checked_out is not null").select("visit_id", "checked_in", F.col("checked_out").alias("closed_at"))


def test_logs_give_the_visits_back(spark, visits, tmp_path):
    log = VisitLog(spark, str(tmp_path))
    assert log.read().count() == 0
    log.open(visits)
    log.close(ends(visits))
    log.close(ends(visits))   # repeated
    columns = visits.columns
    assert rows(log.read().select(*columns)) == rows(visits)
    before = rows(log.read())
    log.compact([date(2024, 1, 2), date(2024, 1, 3)])
    assert rows(log.read()) == before
    log.compact([date(2024, 1, 2)])   # nothing new: no further version
    assert log._bases()[date(2024, 1, 2)].current().number == 1
    late = visits.filter("visit_id = 4").select("visit_id", "checked_in", F.expr("checked_in + interval 3 days").alias("closed_at"))
    log.close(late)   # a closing for a compacted date
    fixed = visits.withColumn("checked_out", F.when(F.col("visit_id") == 4, F.expr("checked_in + interval 3 days")).otherwise(F.col("checked_out")))
    assert rows(log.read().select(*columns)) == rows(fixed)
    log.compact([date(2024, 1, 2)])
    assert rows(log.read().select(*columns)) == rows(fixed)


@pytest.mark.parametrize("hours", [0, 33, 100, 400])
def test_any_instant_can_be_read(spark, visits, tmp_path, hours):
    log = VisitLog(spark, str(tmp_path))
    log.open(visits)
    log.close(ends(visits))
    log.compact([date(2024, 1, 3)])
    now = T0 + timedelta(hours=hours)
    at = F.lit(now).cast("timestamp_ntz")
    expected = visits.filter(F.col("checked_in") <= at).withColumn("checked_out", F.when(F.col("checked_out") <= at, F.col("checked_out")))
    got = log.read(as_of=now)
    assert rows(got.select(*visits.columns)) == rows(expected)
    assert all("local_date" in f for f in partition_filters(got) if f) and sum("local_date" in f for f in partition_filters(got)) >= 2
    recent = log.read(since=now)
    assert rows(recent.select("visit_id")) == rows(visits.filter(F.col("checked_in") >= at).select("visit_id"))


def test_closing_touches_only_its_date(spark, visits, tmp_path):
    log = VisitLog(spark, str(tmp_path))
    log.open(visits)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}
    before = files()
    log.close(ends(visits).filter("visit_id in (1, 2)"))
    new = files() - before
    assert before <= files() and {re.search(r"local_date=([0-9-]+)", f).group(1) for f in new} == {"2024-01-01", "2024-01-02"}


def test_three_zones_read_what_another_wrote(spark, visits, tmp_path):
    for zone in ("Asia/Kolkata", "America/Los_Angeles", "Pacific/Auckland"):
        log = VisitLog(spark, str(tmp_path / zone.replace("/", "-")), zone)
        log.open(visits)
        log.close(ends(visits))
        log.compact([date(2024, 1, 4)])
        now = T0 + timedelta(hours=70)
        assert rows(log.read(as_of=now).select("visit_id", "checked_in")) == rows(visits.filter(F.col("checked_in") <= F.lit(now).cast("timestamp_ntz")).select("visit_id", "checked_in"))


def test_refresh_counts_only_the_changed_dates(spark, small, make, visits, tmp_path):
    from dataclasses import replace
    log, counts = VisitLog(spark, str(tmp_path / "v")), Versions(spark, str(tmp_path / "c"), analytics.HOURLY_COUNTS)
    log.open(visits.filter("visit_id < 30"))
    analytics.refresh_hourly_counts(counts, log.read())
    log.open(visits.filter("visit_id >= 30"))
    changed = [r[0] for r in log.read(since=T0 + timedelta(hours=210)).select("local_date").distinct().collect()]
    analytics.refresh_hourly_counts(counts, log.read(), changed)
    whole = analytics.hourly_stats(replace(small, visits=visits), weeks=1)
    assert rows(analytics.stats_from_counts(counts.read(), 1).select(*whole.columns)) == rows(whole)
    read = log.read().filter(F.col("local_date").isin(*changed))
    assert any("local_date" in f for f in partition_filters(read))
    page = analytics.analytics(replace(small, visits=visits), datetime(2024, 3, 15, 12), counts=counts)["peak_hours"]
    assert page.count() == analytics.stats_from_counts(counts.read()).count()


def test_numbers_of_sparse_and_null_keys(spark):
    ids = [0, 1, 2, 5, 2 ** 40, 2 ** 62, 2 ** 62 + 1, 2 ** 63 - 1, None]
    df = spark.createDataFrame([(s, i) for s in (1, 2, None) for i in ids], "site_id int, member_id long").repartition(5)
    got = {(r.site_id, r.member_id): (r.rn, r.n) for r in sampling.row_numbers(df, ["member_id"], ["site_id"], "rn", "n").collect()}
    order = sorted(ids, key=lambda v: (v is not None, v or 0))
    assert got == {(s, i): (k + 1, 9) for s in (1, 2, None) for k, i in enumerate(order)}
    every = [r.rn for r in sampling.row_numbers(df, ["site_id", "member_id"]).orderBy("site_id", "member_id").collect()]
    assert every == list(range(1, 28))


def test_guarded_loads(spark, small, tmp_path):
    folder = str(tmp_path)
    first = loads.load_all(spark, folder, small)
    assert {(n, o) for n, o, _ in first} == {(n, "loaded" if n != "anomalies" else "refused") for n, _, _ in first}
    assert loads.load(loads.table_versions(spark, folder, "members"), small.members.limit(3), least=12) == ("refused", 12)
    back = loads.read_all(spark, folder)
    assert rows(back.members) == rows(small.members) and back.anomalies.count() == 0
    assert loads.load(loads.table_versions(spark, folder, "sites"), small.sites.drop("status").limit(1)) == ("loaded", 1)
    assert loads.read_all(spark, folder).sites.first().status == "active"
