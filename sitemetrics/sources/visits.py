"""Visits as two append-only logs, openings and closings, merged when read.

Closing a visit appends one row beside it; no stored row changes. Both logs are partitioned by the local date of the check-in, so a closing
touches the date of its visit only, and reads for a time window or an earlier instant prune dates in both logs. `compact` merges the log
files of some dates into one base version per date; rows that come later for such a date are merged on read like others.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemetrics.functions import timeutil as tu
from sitemetrics.sources.store import Versions

OPENED = "visit_id bigint, member_id bigint, site_id int, checked_in timestamp_ntz, local_date date"
CLOSED = "visit_id bigint, closed_at timestamp_ntz, local_date date"
BASE = "visit_id bigint, member_id bigint, site_id int, checked_in timestamp_ntz, checked_out timestamp_ntz, local_date date"


class VisitLog:
    def __init__(self, spark: SparkSession, root: str, tz: str = tu.DEFAULT_TZ):
        self.spark, self.root, self.tz = spark, root.rstrip("/"), tz

    def _append(self, rows: DataFrame, name: str) -> None:
        # A busy date may have several files; every file has one date.
        rows.repartitionByRange("local_date", "visit_id").write.mode("append").partitionBy("local_date").parquet(f"{self.root}/{name}")

    def _day(self, at: str):
        return tu.local_date(F.col(at), self.tz).alias("local_date")

    def open(self, visits: DataFrame) -> None:
        """Append openings (visit_id, member_id, site_id, checked_in)."""
        self._append(visits.select("visit_id", "member_id", "site_id", "checked_in", self._day("checked_in")), "opened")

    def close(self, closures: DataFrame) -> None:
        """Append closings (visit_id, checked_in, closed_at) of stored visits; of repeated ones the last counts."""
        self._append(closures.select("visit_id", "closed_at", self._day("checked_in")), "closed")

    def _log(self, name: str, schema: str, days, folded: set[str] = frozenset()) -> DataFrame:
        path, files = Versions(self.spark, self.root, schema)._files(f"{self.root}/{name}")
        if not files.exists(path):
            return self.spark.createDataFrame([], schema)
        rows = days(self.spark.read.schema(schema).parquet(f"{self.root}/{name}"))
        return rows if not folded else rows.filter(~F.col("_metadata.file_path").isin(*sorted(folded)))

    def _bases(self) -> dict[date, Versions]:
        """The dates that have a base version."""
        path, files = Versions(self.spark, self.root, BASE)._files(f"{self.root}/base")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return {date.fromisoformat(n): Versions(self.spark, f"{self.root}/base/{n}", BASE) for n in sorted(names)}

    def read(self, as_of: datetime | None = None, since: datetime | None = None, only: list[date] | None = None) -> DataFrame:
        """Visits (visit_id, member_id, site_id, checked_in, checked_out, local_date), as they stood at `as_of` where given.

        `since`: only visits that began then or later; `only`: only some local dates. Both prune the dates that are read."""
        first = None if since is None else tu._local_day(since, self.tz)
        last = None if as_of is None else tu._local_day(as_of, self.tz)

        def wanted(day):
            return (first is None or day >= first) and (last is None or day <= last) and (only is None or day in only)

        def days(rows):
            for bound in ([] if first is None else [F.col("local_date") >= F.lit(first)]) + ([] if last is None else [F.col("local_date") <= F.lit(last)]):
                rows = rows.filter(bound)
            return rows if only is None else rows.filter(F.col("local_date").isin(*only))
        bases = {day: v.current() for day, v in self._bases().items() if wanted(day)}
        folded = {f for v in bases.values() for f in v.info["files"]}
        opened = self._log("opened", OPENED, days, folded).withColumn("checked_out", F.lit(None).cast("timestamp_ntz"))
        if bases:
            opened = opened.unionByName(self.spark.read.schema(BASE).parquet(*[v.folder for v in bases.values()]))
        closed = self._log("closed", CLOSED, days, folded)
        if as_of is not None:
            now = tu.ts(as_of)
            opened = opened.filter(F.col("checked_in") <= now).withColumn("checked_out", F.when(F.col("checked_out") <= now, F.col("checked_out")))
            closed = closed.filter(F.col("closed_at") <= now)
        if since is not None:
            opened = opened.filter(F.col("checked_in") >= tu.ts(since))
        closed = closed.groupBy("local_date", "visit_id").agg(F.max("closed_at").alias("closed_at"))
        return (opened.join(closed, ["local_date", "visit_id"], "left")
                .select("visit_id", "member_id", "site_id", "checked_in", F.greatest("checked_out", "closed_at").alias("checked_out"), "local_date"))

    def compact(self, dates: list[date]) -> None:
        """Merge the files of some local dates into one base version per date; each date is committed by itself."""
        bases = self._bases()
        for day in dates:
            versions = bases.get(day) or Versions(self.spark, f"{self.root}/base/{day.isoformat()}", BASE)
            at = versions.current()
            seen = set(at.info.get("files", []))
            files = seen | {r[0] for name, schema in (("opened", OPENED), ("closed", CLOSED))
                            for r in self._log(name, schema, lambda rows: rows.filter(F.col("local_date") == F.lit(day)))
                            .select("_metadata.file_path").distinct().collect()}   # the files of one date
            if files != seen:
                versions.write(self.read(only=[day]), at, {"files": sorted(files)})
