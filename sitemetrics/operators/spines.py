"""Calendars and hour pools."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import metrics


def site_open_hours(sites: DataFrame) -> DataFrame:
    """Hours whose interval [h, h+1) overlaps the opening interval. 24 candidates a site, no join."""
    h = F.col("hour")
    return (sites.select("site_id", "opens_min", "closes_min", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
            .filter((h * 60 < F.col("closes_min")) & ((h + 1) * 60 > F.col("opens_min")))
            .select("site_id", "hour"))


def hour_pool(sites: DataFrame) -> DataFrame:
    """Open hours, each repeated round(weight * 100) times, as a sorted array per site (at most 2,400 items)."""
    weights = F.array(*[F.lit(int(round(w * 100))) for w in metrics.HOUR_WEIGHTS])
    return (site_open_hours(sites)
            .withColumn("hour", F.explode(F.array_repeat("hour", F.element_at(weights, F.col("hour") + 1))))
            .groupBy("site_id").agg(F.array_sort(F.collect_list("hour")).alias("hours")))


def member_day_spine(members: DataFrame, first: date, last: date) -> DataFrame:
    """One row per active member and day with the day's visit weight; expanded in place, no join."""
    days = F.sequence(F.lit(first), F.lit(last))
    return (members.filter(F.col("status") == "active")
            .select("member_id", "site_id", F.explode(days).alias("day"))
            .withColumn("weight", metrics.visit_weight(F.col("day"))))
