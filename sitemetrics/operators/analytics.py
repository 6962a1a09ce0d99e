"""Reports over a period: revenue mix, ranking, churn, peak-hour heatmap."""

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.functions import metrics
from sitemetrics.functions import timeutil as tu
from sitemetrics.functions.timeutil import DEFAULT_TZ
from sitemetrics.sources.store import Version, Versions
from sitemetrics.sources.tables import Tables

DATE_RANGES = {"7d": 7, "30d": 30, "90d": 90}


def range_days(date_range: str) -> int:
    if date_range not in DATE_RANGES:
        raise ValueError(f"date_range must be one of: {', '.join(DATE_RANGES)}")
    return DATE_RANGES[date_range]


# Turns the exclusive upper bound of a window into an inclusive one.
INSTANT = timedelta(microseconds=1)


def _since_local_day(t: Tables, as_of: datetime, days: int, tz: str) -> DataFrame:
    """Payments since local midnight `days` days ago up to `as_of`: `days` full days and the partial today."""
    return tu.within(t.payments, "paid_at", tu.local_midnight(as_of, tz, -days), as_of + INSTANT, tz)


def revenue_by_plan(t: Tables, as_of: datetime, days: int, tz: str = DEFAULT_TZ) -> DataFrame:
    return (_since_local_day(t, as_of, days, tz).groupBy("site_id", "plan_type")
            .agg(F.sum("amount").cast("double").alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), "site_id", "plan_type"))


def revenue_by_plan_ranges(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """All selectable ranges from one scan of the longest."""
    def total(label):
        lo = tu.ts(tu.local_midnight(as_of, tz, -DATE_RANGES[label]))
        return F.sum(F.when(F.col("paid_at") >= lo, F.col("amount"))).cast("double").alias(f"revenue_{label}")
    longest = max(DATE_RANGES.values())
    return (_since_local_day(t, as_of, longest, tz).groupBy("site_id", "plan_type")
            .agg(*[total(label) for label in DATE_RANGES]))


def new_vs_renewal(t: Tables, as_of: datetime, days: int, tz: str = DEFAULT_TZ) -> DataFrame:
    return (_since_local_day(t, as_of, days, tz).groupBy("site_id", F.col("payment_type").alias("member_type"))
            .agg(F.count(F.lit(1)).alias("count")))


def revenue_30d_by_site(t: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """Rolling `days` x 24 h; sites without payments are absent."""
    return (tu.within(t.payments, "paid_at", as_of - timedelta(days=days), as_of + INSTANT).groupBy("site_id")
            .agg(F.sum("amount").cast("double").alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), "site_id"))


def site_revenue_rank(t: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """Dense rank of all sites by rolling revenue; sites without payments rank with zero."""
    sums = (tu.within(t.payments, "paid_at", as_of - timedelta(days=days), as_of + INSTANT).groupBy("site_id")
            .agg(F.sum("amount").alias("total")))
    total = F.coalesce("total", F.lit(0).cast("decimal(22,2)"))
    # One row a site reaches the unpartitioned window.
    ranked = (t.sites.join(t.site_bounded(sums), "site_id", "left")
              .select("site_id", F.col("name").alias("site_name"), total.cast("double").alias("total_revenue"),
                      F.dense_rank().over(Window.orderBy(total.desc())).alias("rank")))
    return ranked.withColumn("is_top", F.col("rank") == 1).orderBy("rank", "site_id")


def site_labels(ranked: DataFrame, prefix: str) -> DataFrame:
    """Chart labels: common prefix stripped, upper case."""
    return ranked.select("site_id", F.upper(F.replace("site_name", F.lit(prefix), F.lit(""))).alias("label"),
                         "total_revenue", "is_top")


def churn_risk(t: Tables, as_of: datetime, high: int = 45, critical: int = 60) -> DataFrame:
    """Active members absent for more than `high` days, longest absence first."""
    last = F.col("last_checkin_at")
    return (t.members.filter((F.col("status") == "active") & (last < tu.ts(as_of - timedelta(days=high))))
            .select("member_id", "site_id", "name", "email", "phone", "last_checkin_at", "plan_expires_at",
                    metrics.churn_level(last, as_of, high, critical).alias("risk_level"),
                    metrics.days_absent(last, as_of).alias("days_absent"))
            .orderBy("last_checkin_at", "member_id"))


def churn_contact(t: Tables, as_of: datetime) -> DataFrame:
    return churn_risk(t, as_of).select("member_id", metrics.contact(F.col("phone"), F.col("email")).alias("contact"))


def churn_count_by_site(t: Tables, as_of: datetime) -> DataFrame:
    return churn_risk(t, as_of).groupBy("site_id").agg(F.count(F.lit(1)).alias("at_risk"))


def hourly_stats(t: Tables, weeks: int = 13, tz: str = DEFAULT_TZ, since: datetime | None = None) -> DataFrame:
    """Average check-ins per (site, local weekday, local hour): count / weeks, rounded."""
    local = tu.to_local(F.col("quarter"), tz)
    average = F.round(F.sum("n").cast("decimal(20,0)") / F.lit(weeks)).cast("int")
    return (tu.within(t.visits, "checked_in", since, None, tz)
            .groupBy("site_id", tu.quarter("checked_in").alias("quarter")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("site_id", tu.dow0(local).alias("day_of_week"), F.hour(local).alias("hour_of_day"))
            .agg(average.alias("checkin_count")))


HOURLY_COUNTS = "site_id int, local_date date, hour_of_day int, visits bigint"


def hourly_counts(visits: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Check-ins per site, local date and local hour."""
    local = tu.to_local(F.col("quarter"), tz)
    return (visits.groupBy("site_id", tu.quarter("checked_in").alias("quarter")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("site_id", F.to_date(local).alias("local_date"), F.hour(local).alias("hour_of_day")).agg(F.sum("n").alias("visits")))


def refresh_hourly_counts(versions: Versions, visits: DataFrame, changed: list[date] | None = None, tz: str = DEFAULT_TZ) -> Version:
    """Next version of the counts: those of the `changed` local dates are counted again, all others are kept.

    `visits` should be partitioned by local date in this zone, then only the changed dates are read. None counts everything."""
    at = versions.current()
    if changed is None or at.folder is None:
        return versions.write(hourly_counts(visits, tz), at)
    some = visits.filter(F.col("local_date").isin(*changed)) if "local_date" in visits.columns else visits.filter(tu.local_date(F.col("checked_in"), tz).isin(*changed))
    kept = versions.read(at).filter(~F.col("local_date").isin(*changed) | F.col("local_date").isNull())
    return versions.write(kept.unionByName(hourly_counts(some, tz)), at)


def stats_from_counts(counts: DataFrame, weeks: int = 13) -> DataFrame:
    """The average table from the stored counts: count / weeks, rounded, per site, weekday and hour."""
    average = F.round(F.sum("visits").cast("decimal(20,0)") / F.lit(weeks)).cast("int")
    return (counts.groupBy("site_id", tu.dow0(F.col("local_date")).alias("day_of_week"), "hour_of_day").agg(average.alias("checkin_count")))


def site_heatmap(stats: DataFrame) -> DataFrame:
    return stats.orderBy("site_id", "day_of_week", "hour_of_day")


def heatmap_grid(t: Tables, weeks: int = 13, tz: str = DEFAULT_TZ) -> DataFrame:
    """Dense 7 x 24 grid per site with heat bands relative to the site's busiest cell (at least 1)."""
    stats = hourly_stats(t, weeks, tz)
    cells = (t.sites.select("site_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_of_week"))
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour_of_day")))
    keys = ["site_id", "day_of_week", "hour_of_day"]
    filled = cells.join(stats, keys, "left").withColumn("checkin_count", F.coalesce("checkin_count", F.lit(0)))
    # 168 cells a site: the window holds a bounded group.
    peak = F.greatest(F.lit(1), F.max("checkin_count").over(Window.partitionBy("site_id")))
    return filled.withColumn("peak", peak).select(
        *keys, "checkin_count", metrics.heat_band(F.col("checkin_count"), F.col("peak")).alias("band"))


def visit_durations(t: Tables) -> DataFrame:
    return t.visits.select("visit_id", metrics.duration_min(F.col("checked_in"), F.col("checked_out")).alias("duration_min"))


def analytics(t: Tables, as_of: datetime, date_range: str = "7d", tz: str = DEFAULT_TZ, counts: Versions | None = None) -> dict[str, DataFrame]:
    """The four reports of the analytics page; an unknown range is rejected before any work. The heatmap comes from the stored counts where given."""
    days = range_days(date_range)
    return {
        "peak_hours": site_heatmap(hourly_stats(t, tz=tz) if counts is None else stats_from_counts(counts.read())),
        "revenue_by_plan": revenue_by_plan(t, as_of, days, tz),
        "churn_risk": churn_risk(t, as_of),
        "member_type": new_vs_renewal(t, as_of, days, tz),
    }
