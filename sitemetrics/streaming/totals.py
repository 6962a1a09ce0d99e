"""Current totals from an append-only log: a stored snapshot plus the files that it has not folded in yet.

The streaming part keeps no state and has no watermark: it appends each event as a narrow row, however late. `Fold` holds partial results
of the rows folded so far, versioned, together with the names of their files. Reading adds the unfolded files to the snapshot,
so results are current after every micro-batch; `advance` moves the snapshot forward. Both work on whole files, which the
file sink commits exactly once: folding twice changes nothing, and a late row is just a row of a new file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitemetrics.functions import timeutil as tu
from sitemetrics.functions.timeutil import DEFAULT_TZ
from sitemetrics.operators import episodes, feed
from sitemetrics.sources.store import Version, Versions


class Fold:
    """A result that is a fold over the rows of a log.

    `partial` turns log rows into partial results, `merge` combines partial results with equal keys; `merge` must not depend on
    how the rows were cut. The schema is that of the partial results."""

    def __init__(self, log: "Log", versions: Versions, partial: Callable, merge: Callable):
        self.log, self.versions, self.partial, self.merge = log, versions, partial, merge

    def _unfolded(self, at: Version) -> list[str]:
        folded = set(at.info.get("files", []))
        return [f for f in self.log.files() if f not in folded]

    def read(self) -> DataFrame:
        """The partial results of all rows of the log."""
        at = self.versions.current()
        new = self._unfolded(at)
        if not new:
            return self.versions.read(at)
        tail = self.partial(self.log.rows(new))
        return self.merge(tail if at.folder is None else self.versions.read(at).unionByName(tail))

    def advance(self) -> Version:
        """Fold the new files into the next version of the snapshot; without new files nothing is written."""
        at = self.versions.current()
        new = self._unfolded(at)
        if not new:
            return at
        tail = self.partial(self.log.rows(new))
        merged = self.merge(tail if at.folder is None else self.versions.read(at).unionByName(tail))
        return self.versions.write(merged, at, {"files": sorted({*at.info.get("files", []), *new})})


class Log:
    """The committed files of an append sink."""

    def __init__(self, spark, sink: str, schema: StructType):
        self.spark, self.sink, self.schema = spark, sink, schema

    def files(self) -> list[str]:
        return self.spark.read.schema(self.schema).parquet(self.sink).inputFiles()

    def rows(self, files: list[str] | None = None) -> DataFrame:
        """All rows, or those of some of the files."""
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(self.sink) if files is None else reader.option("basePath", self.sink).parquet(*files)


# --------------------------------------------------------------------------- occupancy and revenue

def ledger(events: DataFrame) -> DataFrame:
    """Streaming part: one narrow row per check-in, check-out and payment."""
    return (events.filter(F.col("kind").isin("in", "out", "payment"))
            .select("event_id", "site_id", "kind", "event_time", F.col("delta").cast("int").alias("delta"),
                    F.col("amount").cast("decimal(12,2)").alias("amount")))


PARTIALS = "site_id int, quarter timestamp_ntz, net bigint, revenue decimal(22,2)"


def quarters(rows: DataFrame) -> DataFrame:
    """Net moves and revenue per site and quarter of an hour. Zone offsets are multiples of it, so local days of any zone are sums of these."""
    at = F.col("event_time").cast("timestamp_ntz")
    return (rows.groupBy("site_id", tu.quarter(at).alias("quarter"))
            .agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("net"), F.sum("amount").cast("decimal(22,2)").alias("revenue")))


def summed(parts: DataFrame) -> DataFrame:
    return (parts.groupBy("site_id", "quarter")
            .agg(F.sum("net").alias("net"), F.sum("revenue").cast("decimal(22,2)").alias("revenue")))


def occupancy(parts: DataFrame, sites: DataFrame) -> DataFrame:
    """Present members of every site."""
    sums = parts.groupBy("site_id").agg(F.sum("net").alias("current_occupancy"))
    return (sites.select("site_id").join(sums, "site_id", "left")
            .select("site_id", F.coalesce("current_occupancy", F.lit(0)).alias("current_occupancy")))


def revenue_by_day(parts: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Revenue of the sites and local days that had payments."""
    return (parts.filter(F.col("revenue").isNotNull()).groupBy("site_id", tu.local_date(F.col("quarter"), tz).alias("day"))
            .agg(F.sum("revenue").cast("decimal(22,2)").alias("revenue")))


def fleet_state(parts: DataFrame, sites: DataFrame, day, tz: str = DEFAULT_TZ) -> DataFrame:
    """Site list kept in step with the stream: occupancy and revenue of local date `day`."""
    today = revenue_by_day(parts, tz).filter(F.col("day") == F.lit(day)).select("site_id", "revenue")
    return (occupancy(parts, sites).join(today, "site_id", "left")
            .select("site_id", "current_occupancy", F.coalesce("revenue", F.lit(0).cast("decimal(22,2)")).alias("today_revenue")))


def fleet_totals(state: DataFrame) -> DataFrame:
    return state.agg(F.sum("current_occupancy").alias("total_occupancy"),
                     F.sum("today_revenue").cast("double").alias("total_revenue"))


def revenue_drops(parts: DataFrame, sites: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    return episodes.revenue_drop_history(episodes.fill_days(revenue_by_day(parts, tz), sites))


# ------------------------------------------------------------------------------------------- feed

def top_of_each_site(n: int = feed.FEED_SIZE) -> Callable:
    """Merge of bounded top lists: the n newest rows of each site, each id once.

    The n newest of the union of two lists are among the n newest of each, so stored lists and new rows can be cut one by one;
    equal rows of an id that came twice are one row. Hot sites are cut per task before the shuffle."""
    def merge(rows: DataFrame) -> DataFrame:
        # An id comes again only with equal columns, so its copies are neighbours in the order: dense_rank counts them once.
        order = Window.partitionBy("site_id").orderBy(F.desc("event_time"), "id")
        near = rows.withColumn("rn", F.dense_rank().over(order)).filter(F.col("rn") <= n).drop("rn")
        return near.dropDuplicates(["site_id", "id"])
    return merge


# --------------------------------------------------------------------------------- silent windows

PANES = "site_id int, pane timestamp_ntz, visits bigint"


def panes(rows: DataFrame, width: str = "30 minutes") -> DataFrame:
    """Check-ins per site and pane; one row a pane, whatever windows are made of them later."""
    at = F.col("event_time").cast("timestamp_ntz")
    return (rows.filter(F.col("kind") == "in").groupBy("site_id", F.window(at, width)["start"].alias("pane"))
            .agg(F.count(F.lit(1)).alias("visits")))


def summed_panes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("site_id", "pane").agg(F.sum("visits").alias("visits"))


def silent_windows(parts: DataFrame, sites: DataFrame, tz: str = DEFAULT_TZ, width: str = "30 minutes", per_window: int = 4) -> DataFrame:
    """Ends of windows of `per_window` panes in which an active site, open at the end, had no check-in.

    Windows end from the first pane's end to the newest pane's end. Every pane with visits covers the windows it is part of; panes
    of silent sites come from the calendar.
    """
    span = parts.agg(F.min("pane").alias("lo"), F.max("pane").alias("hi")).first()
    step = F.expr(f"interval {width}")
    if span.lo is None:
        return parts.select("site_id", F.col("pane").alias("window_end")).limit(0)
    spine = (sites.filter(F.col("status") == "active")
             .select("site_id", "opens_min", "closes_min", F.explode(F.sequence(tu.ts(span.lo) + step, tu.ts(span.hi) + step, step)).alias("window_end")))
    minute = tu.minute_of_day(tu.to_local(F.col("window_end"), tz))
    reach = F.transform(F.sequence(F.lit(1), F.lit(per_window)), lambda k: F.col("pane") + k * step)
    seen = parts.select("site_id", F.explode(reach).alias("window_end")).distinct()
    return (spine.filter((F.col("opens_min") < minute) & (F.col("closes_min") >= minute))
            .join(seen, ["site_id", "window_end"], "left_anti").select("site_id", "window_end"))
