"""The bundle of the five tables: typed reads, defaults, partitioned writes, rewinding to an instant."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemetrics import schemas
from sitemetrics.functions import timeutil as tu
from sitemetrics.session import MAX_BROADCAST_ROWS, configure

DATE_OF = {"visits": "checked_in", "payments": "paid_at"}
# Partition columns of the stored fact tables.
LAYOUT = {"visits": [T.StructField("is_open", T.BooleanType()), T.StructField("local_date", T.DateType())],
          "payments": [T.StructField("local_date", T.DateType())]}


ACTIVITY = "site_id int, local_date date, events bigint, oldest timestamp_ntz, newest timestamp_ntz"


@dataclass(frozen=True)
class Tables:
    sites: DataFrame
    members: DataFrame
    visits: DataFrame
    payments: DataFrame
    anomalies: DataFrame | None = None
    # Events per site and local date, where the tables are stored with it (feed.activity_days).
    activity: DataFrame | None = None

    @cached_property
    def n_sites(self) -> int:
        """Number of sites, counted no further than the broadcast bound."""
        return self.sites.select("site_id").limit(MAX_BROADCAST_ROWS + 1).count()

    def site_bounded(self, df: DataFrame, rows_per_site: int = 1) -> DataFrame:
        """Broadcast `df`, known to hold at most `rows_per_site` rows a site, if the checked site count allows.

        Beyond the bound the join stays a shuffle join, which AQE splits on skewed keys.
        """
        return F.broadcast(df) if self.n_sites * rows_per_site <= MAX_BROADCAST_ROWS else df

    def rewind(self, as_of: datetime) -> Tables:
        """The tables as they stood at `as_of`: later rows are gone, later closings not yet made."""
        now = tu.ts(as_of)
        visits = (self.visits.drop("is_open").filter(F.col("checked_in") <= now)
                  .withColumn("checked_out", F.when(F.col("checked_out") <= now, F.col("checked_out"))))
        anomalies = self.anomalies
        if anomalies is not None:
            done = F.col("resolved") & (F.col("resolved_at") <= now)
            anomalies = (anomalies.filter(F.col("detected_at") <= now)
                         .withColumn("resolved", F.coalesce(done, F.lit(False)))
                         .withColumn("resolved_at", F.when(F.col("resolved"), F.col("resolved_at"))))
        return replace(self, visits=visits, payments=self.payments.filter(F.col("paid_at") <= now),
                       anomalies=anomalies, activity=None)

    def only(self, site_ids: list[int]) -> Tables:
        """All tables restricted to some sites."""
        def keep(df):
            return None if df is None else df.filter(F.col("site_id").isin(*site_ids))
        return Tables(*[keep(df) for df in (self.sites, self.members, self.visits, self.payments, self.anomalies)])

    def none(self) -> Tables:
        """The same tables without rows."""
        return Tables(*[None if df is None else df.filter(F.lit(False)) for df in (self.sites, self.members, self.visits, self.payments, self.anomalies)])


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in schemas.DEFAULTS[table].items()})


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    schema = T.StructType(schemas.TABLES[table].fields + LAYOUT.get(table, []))
    return with_defaults(spark.read.schema(schema).parquet(f"{folder}/{table}"), table)


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """Typed scan of all five tables below `folder`; schemas are declared, never inferred."""
    configure(spark)
    return Tables(*[read_table(spark, folder, t) for t in ("sites", "members", "visits", "payments", "anomalies")],
                  activity=spark.read.schema(ACTIVITY).parquet(f"{folder}/activity"))


def write_tables(tables: Tables, folder: str, tz: str = tu.DEFAULT_TZ) -> None:
    """Write the bundle. The fact tables are partitioned by local date, so time windows prune files, and visits
    by open or closed as well, so live queries read the open ones alone."""
    _write(tables, folder, tz, "errorifexists", schemas.TABLES)


def append_facts(tables: Tables, folder: str, tz: str = tu.DEFAULT_TZ) -> None:
    """Append further visits and payments to written tables."""
    _write(tables, folder, tz, "append", DATE_OF)


def _write(tables: Tables, folder: str, tz: str, mode: str, names) -> None:
    from sitemetrics.operators.feed import activity_days
    for name in names:
        df = getattr(tables, name)
        if df is not None:
            write_table(df, folder, name, tz, mode)
    activity_days(tables, tz).write.mode(mode).parquet(f"{folder}/activity")


def write_table(df: DataFrame, folder: str, name: str, tz: str = tu.DEFAULT_TZ, mode: str = "errorifexists") -> None:
    """Write one table; columns beyond the schema stay in its files."""
    if name not in DATE_OF:
        df.write.mode(mode).parquet(f"{folder}/{name}")
        return
    # Range partitioning splits a busy date over several files; time order helps row-group pruning.
    layout = [f.name for f in LAYOUT[name]]
    if name == "visits":
        df = df.withColumn("is_open", F.col("checked_out").isNull())
    (df.withColumn("local_date", tu.local_date(F.col(DATE_OF[name]), tz)).repartitionByRange(*layout, DATE_OF[name])
     .sortWithinPartitions(*layout, DATE_OF[name]).write.mode(mode).partitionBy(*layout).parquet(f"{folder}/{name}"))


def is_seeded(tables: Tables) -> bool:
    """Emptiness guard before a first load."""
    return not tables.sites.isEmpty()
