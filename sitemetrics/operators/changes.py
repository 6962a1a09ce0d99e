"""Row-changing operations as DataFrame -> DataFrame; the caller writes the result as a new version."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import timeutil as tu
from sitemetrics.sources.tables import Tables


def close_visits(visits: DataFrame, closures: DataFrame) -> DataFrame:
    """Set checked_out of the visits in `closures` (visit_id, closed_at); a repeated id keeps the last closing."""
    visits = visits.drop("is_open")  # layout column of the stored table, recomputed when written
    last = closures.groupBy("visit_id").agg(F.max("closed_at").alias("closed_at"))
    return (visits.join(last, "visit_id", "left")
            .withColumn("checked_out", F.coalesce("closed_at", "checked_out")).select(*visits.columns))


def last_visit(visits: DataFrame) -> DataFrame:
    return visits.groupBy("member_id").agg(F.max("checked_in").alias("last_at"))


def sync_last_visit(members: DataFrame, visits: DataFrame, strict: bool = False) -> DataFrame:
    """Set last_checkin_at to the member's newest visit.

    Members without visits keep their value (as an UPDATE ... FROM join does); strict=True clears it.
    """
    synced = F.col("last_at") if strict else F.coalesce("last_at", "last_checkin_at")
    return (members.join(last_visit(visits), "member_id", "left")
            .withColumn("last_checkin_at", synced).select(*members.columns))


def advance_last_visit(members: DataFrame, visits: DataFrame) -> DataFrame:
    """Incremental form for new visits only: the value never moves back."""
    return (members.join(last_visit(visits), "member_id", "left")
            .withColumn("last_checkin_at", F.greatest("last_checkin_at", "last_at")).select(*members.columns))


def reset_baseline(t: Tables, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(visits without the open ones, members resynchronised with them)."""
    closed = t.visits.filter(F.col("checked_out").isNotNull())
    return closed, sync_last_visit(t.members, closed, strict)


def last_visit_mismatch(t: Tables) -> DataFrame:
    """Members whose stored last visit differs (null-safe) from the newest visit."""
    return (t.members.join(last_visit(t.visits), "member_id", "left")
            .filter(~F.col("last_checkin_at").eqNullSafe(F.col("last_at")))
            .select("member_id", "last_checkin_at", F.col("last_at")))


def replace_cohort(visits: DataFrame, cohort: DataFrame, as_of: datetime, days_ago: Column, at: Column,
                   stay: Column, tz: str = tu.DEFAULT_TZ) -> DataFrame:
    """Delete all visits of `cohort` (member_id, site_id) and give each member one old, closed visit instead.

    The same cohort rows drive both steps. `days_ago` days, `at` minutes after local midnight, `stay` minutes.
    New ids are negative, so they never meet stored ones.
    """
    start = (tu.ts(tu.local_midnight(as_of, tz)) - F.make_dt_interval(days=days_ago)
             + F.make_dt_interval(mins=at))
    fresh = cohort.select((-F.col("member_id") - 1).alias("visit_id"), "member_id", "site_id",
                          start.alias("checked_in"), (start + F.make_dt_interval(mins=stay)).alias("checked_out"))
    kept = visits.join(cohort.select("member_id"), "member_id", "left_anti").select(*fresh.columns)
    return kept.unionByName(fresh)


def windowed_delete(df: DataFrame, col: str, lo: datetime, sites: list[int]) -> DataFrame:
    """Delete rows of the given sites at or after `lo`."""
    return df.filter(~(F.col("site_id").isin(*sites) & (F.col(col) >= tu.ts(lo))))


def cascade_delete(t: Tables, members: DataFrame) -> Tables:
    """Delete members (member_id) with their visits and payments."""
    def without(df):
        return df.join(members.select("member_id"), "member_id", "left_anti").select(*df.columns)
    return Tables(t.sites, without(t.members), without(t.visits), without(t.payments), t.anomalies)


def delete_sites(t: Tables, sites: DataFrame) -> Tables:
    """Delete sites (site_id): refused while members refer to them, otherwise cascades to the facts."""
    keys = sites.select("site_id")
    if not t.members.join(keys, "site_id", "left_semi").isEmpty():
        raise ValueError("sites still have members")

    def without(df):
        return None if df is None else df.join(keys, "site_id", "left_anti").select(*df.columns)
    return Tables(without(t.sites), t.members, without(t.visits), without(t.payments), without(t.anomalies))
