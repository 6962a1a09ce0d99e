"""The capacity rule over a log whose rows may come late.

Stored are, per site and block of time, one row (net, low, carry) that says how the block changes the occupancy before it, and the runs of
the rule's marks inside the blocks. A new row, however late, makes its own block's summary new; the scan over the one-row summaries gives
every block its occupancy again, and only blocks that were touched or whose occupancy before them has moved are read again.
Openings and closings follow from the runs. One version holds both kinds of row, so they never disagree.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.operators import episodes
from sitemetrics.session import cut
from sitemetrics.sources.store import Version, Versions
from sitemetrics.streaming.totals import Log

STATE = ("site_id int, block bigint, net bigint, low bigint, carry bigint, event_time timestamp_ntz, event_id string, "
         "occupancy bigint, mark int, before int")


def moves(events: DataFrame) -> DataFrame:
    """Streaming part: one narrow row per check-in and check-out."""
    return (events.filter(F.col("kind").isin("in", "out"))
            .select("site_id", "event_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), F.col("delta").cast("int").alias("delta")))


class CapacityFold:
    """Openings and closings of all rows of the log, whatever order they came in. `capacity`: site_id, capacity."""

    def __init__(self, log: Log, versions: Versions, capacity: DataFrame, block: timedelta = episodes.BLOCK):
        self.log, self.versions, self.capacity, self.block = log, versions, capacity, block

    def advance(self) -> Version:
        """Take in the files that came since the last version."""
        at = self.versions.current()
        known = set(at.info.get("files", []))
        new = [f for f in self.log.files() if f not in known]
        if not new:
            return at
        keys = ["site_id", "block"]
        stored = self.versions.read(at)
        blocks = stored.filter(F.col("net").isNotNull())
        where = episodes._block(F.col("event_time"), self.block)
        touched = cut(self.log.rows(new).select("site_id", where.alias("block")).filter("site_id is not null and block is not null").distinct())
        rows = self.log.rows().withColumn("block", where)

        def of(some):
            return episodes.steps(rows.join(some.select(*keys), keys, "left_semi").drop("block"), self.block)
        fresh = episodes.summaries(of(touched))
        merged = blocks.select(*keys, "net", "low").join(touched, keys, "left_anti").unionByName(fresh)
        chain = cut(episodes.chained(merged))
        moved = (chain.join(blocks.select(*keys, F.col("carry").alias("was")), keys, "left").join(touched.withColumn("hit", F.lit(True)), keys, "left")
                 .filter(F.col("hit") | ~F.col("carry").eqNullSafe(F.col("was"))).select(*chain.columns))
        moved = cut(moved)
        runs = episodes.marked_runs(of(moved), moved, self.capacity).select(*keys, "event_time", "event_id", "occupancy", "mark", "before")
        kept = stored.filter(F.col("mark").isNotNull()).join(moved, keys, "left_anti").select(*runs.columns)
        both = chain.select(*keys, "net", "low", "carry").unionByName(kept.unionByName(runs), allowMissingColumns=True)
        return self.versions.write(both, at, {"files": sorted(known.union(new))})

    def runs(self) -> DataFrame:
        return (self.versions.read().filter(F.col("mark").isNotNull())
                .select("site_id", "block", "event_time", "event_id", "occupancy", "mark", "before"))

    def transitions(self) -> DataFrame:
        """Every opening (mark 1) and closing (mark 0)."""
        return episodes.transitions(self.runs())
