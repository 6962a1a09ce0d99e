"""Live state of all sites in one job: occupancy, today's revenue, overview, eligibility."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import metrics
from sitemetrics.functions import timeutil as tu
from sitemetrics.functions.timeutil import DEFAULT_TZ
from sitemetrics.sources.tables import Tables


def active_sites(t: Tables) -> DataFrame:
    return (t.sites.filter(F.col("status") == "active")
            .select("site_id", "name", "capacity", "opens_min", "closes_min", "status"))


def site_operating(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """Every reading of the opening hours side by side."""
    opens, closes = F.col("opens_min"), F.col("closes_min")
    return t.sites.select("site_id", *[tu.is_open(as_of, opens, closes, tz, mode).alias(f"open_{mode}")
                                       for mode in ("detector", "inclusive", "half_open")])


def open_visits(visits: DataFrame) -> DataFrame:
    """Visits without an end. On stored tables only the partitions of open visits are read."""
    if "is_open" in visits.columns:
        visits = visits.filter(F.col("is_open")).drop("is_open")
    return visits.filter(F.col("checked_out").isNull())


def _per_site(t: Tables, per_site: DataFrame, **zeros) -> DataFrame:
    """All sites with their (at most one) row of `per_site`; absent ones get the given zeros."""
    joined = t.sites.join(t.site_bounded(per_site), "site_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(z)) for c, z in zeros.items()})


def occupancy(t: Tables) -> DataFrame:
    """Open visits of the sites that have any."""
    return open_visits(t.visits).groupBy("site_id").agg(F.count(F.lit(1)).alias("current_occupancy"))


def live_occupancy(t: Tables) -> DataFrame:
    return _per_site(t, occupancy(t), current_occupancy=0).select("site_id", "current_occupancy")


def _revenue_today(t: Tables, as_of: datetime, tz: str) -> DataFrame:
    day = tu.within(t.payments, "paid_at", tu.local_midnight(as_of, tz), tu.local_midnight(as_of, tz, 1), tz)
    return day.groupBy("site_id").agg(F.sum("amount").cast("double").alias("today_revenue"))


def today_revenue(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """Revenue of the local calendar day of `as_of`."""
    return _per_site(t, _revenue_today(t, as_of, tz), today_revenue=0.0).select("site_id", "today_revenue")


def zero_totals() -> dict:
    """Both totals with zero for absent sites."""
    zero = F.lit(0).cast("decimal(22,2)")
    return {c: F.coalesce(F.col(c), zero) for c in ("today_total", "last_week_total")}


def revenue_totals(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """Today (so far) and the same weekday a week ago (whole day), in one scan of the last eight days."""
    today, tomorrow = tu.local_midnight(as_of, tz), tu.local_midnight(as_of, tz, 1)
    then, then_end = tu.local_midnight(as_of, tz, -7), tu.local_midnight(as_of, tz, -6)
    paid = F.col("paid_at")
    in_today, in_then = paid >= tu.ts(today), paid < tu.ts(then_end)
    return (tu.within(t.payments, "paid_at", then, tomorrow, tz).filter(in_today | in_then)
            .groupBy("site_id")
            .agg(F.sum(F.when(in_today, F.col("amount"))).alias("today_total"),
                 F.sum(F.when(in_then, F.col("amount"))).alias("last_week_total")))


def revenue_today_vs_last_week(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    totals = t.site_bounded(revenue_totals(t, as_of, tz))
    return t.sites.join(totals, "site_id", "left").withColumns(zero_totals()).select("site_id", *zero_totals())


def recent_visits(t: Tables, as_of: datetime, hours: int = 2, tz: str = DEFAULT_TZ) -> DataFrame:
    """Check-ins of the last `hours` up to and with `as_of`; later rows of the table do not count."""
    return (tu.within(t.visits, "checked_in", as_of - timedelta(hours=hours), as_of + timedelta(microseconds=1), tz)
            .groupBy("site_id").agg(F.count(F.lit(1)).alias("recent_count")))


def recent_visit_count(t: Tables, as_of: datetime, hours: int = 2) -> DataFrame:
    return _per_site(t, recent_visits(t, as_of, hours), recent_count=0).select("site_id", "recent_count")


def site_overview(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """Every site with occupancy and today's revenue, by name. Facts are aggregated before the joins."""
    both = (t.sites.join(t.site_bounded(occupancy(t)), "site_id", "left")
            .join(t.site_bounded(_revenue_today(t, as_of, tz)), "site_id", "left"))
    return (both.select("site_id", "name", "city", "capacity", "status",
                        F.coalesce("current_occupancy", F.lit(0)).alias("current_occupancy"),
                        F.coalesce("today_revenue", F.lit(0.0)).alias("today_revenue"))
            .orderBy("name"))


def fleet_summary(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    return (site_overview(t, as_of, tz)
            .agg(F.sum("current_occupancy").alias("total_occupancy"),
                 F.sum(F.col("today_revenue").cast("decimal(18,2)")).cast("double").alias("total_revenue")))


def occupancy_status(t: Tables) -> DataFrame:
    """Occupancy with percent of capacity, band and the bar fill capped at 100."""
    percent = metrics.capacity_pct(F.col("current_occupancy"), F.col("capacity"))
    return (_per_site(t, occupancy(t), current_occupancy=0)
            .withColumn("capacity_pct", percent)
            .select("site_id", "current_occupancy", "capacity", "capacity_pct",
                    metrics.occupancy_band(F.col("capacity_pct")).alias("band"),
                    F.least(F.col("capacity_pct"), F.lit(100.0)).alias("bar_pct")))


def open_visits_enriched(t: Tables) -> DataFrame:
    """Open visits with member name and site capacity. Skew on either key is left to AQE's skew join."""
    return (open_visits(t.visits).select("visit_id", "member_id", "site_id")
            .join(t.members.select("member_id", F.col("name").alias("member_name")), "member_id")
            .join(t.site_bounded(t.sites.select("site_id", "capacity")), "site_id")
            .select("visit_id", "site_id", "member_id", "member_name", "capacity"))


def active_members(t: Tables) -> DataFrame:
    return (t.members.filter(F.col("status") == "active")
            .select("member_id", F.col("name").alias("member_name"), "site_id", "plan_type"))


def eligible_members(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """Active members of active, currently open sites who have no open visit."""
    sites = (t.sites.filter((F.col("status") == "active")
                            & tu.is_open(as_of, F.col("opens_min"), F.col("closes_min"), tz, "inclusive"))
             .select("site_id", "capacity"))
    return (t.members.filter(F.col("status") == "active")
            .join(t.site_bounded(sites), "site_id")
            .join(_open_member_ids(t), "member_id", "left_anti")
            .select("member_id", F.col("name").alias("member_name"), "site_id", "capacity"))


def members_with_open_visit(t: Tables) -> DataFrame:
    return (t.members.join(_open_member_ids(t), "member_id", "left_semi")
            .select("member_id", F.col("name").alias("member_name")))


def _open_member_ids(t: Tables) -> DataFrame:
    # One row a member before the shuffle join, whatever the number of open visits.
    return open_visits(t.visits).select("member_id").distinct()
