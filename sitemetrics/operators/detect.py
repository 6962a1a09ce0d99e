"""One detection cycle for all active sites: evaluate the rules, open and resolve anomalies."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import rules
from sitemetrics.functions import timeutil as tu
from sitemetrics.functions.timeutil import DEFAULT_TZ
from sitemetrics.operators import live
from sitemetrics.schemas import EVENT_TYPES
from sitemetrics.session import cut
from sitemetrics.sources.tables import Tables


def _rules(as_of: datetime, tz: str) -> dict[str, Column]:
    """struct(trigger, resolve, message) per rule, over a row with the site and its counts and totals."""
    c = F.col
    opened_now = tu.is_open(as_of, c("opens_min"), c("closes_min"), tz)
    load, sales = rules.capacity_flags(c("current_occupancy"), c("capacity")), rules.revenue_flags(c("today_total"), c("last_week_total"))

    def known(value, text, *args):
        return F.when(value.isNotNull(), F.format_string(text, c("name"), rules.one_decimal(value), *args))

    def verdict(trigger, resolve, message):
        return F.struct(trigger.alias("trigger"), resolve.alias("resolve"), message.alias("message"))
    return {
        "zero_checkins": verdict(rules.zero_visits_trigger(c("status"), opened_now, c("recent_count")), c("recent_count") > 0,
                                 F.format_string(rules.ZERO_MESSAGE, "name")),
        "capacity_breach": verdict(load["trigger"], load["resolve"], known(
            load["pct"], rules.CAPACITY_MESSAGE, c("current_occupancy"), c("capacity"))),
        "revenue_drop": verdict(sales["trigger"], sales["resolve"], known(sales["drop_pct"], rules.REVENUE_MESSAGE)),
    }


def _active(t: Tables, *per_site: DataFrame) -> DataFrame:
    """Active sites with the given one-row-a-site measures."""
    df = live.active_sites(t)
    for measure in per_site:
        df = df.join(t.site_bounded(measure), "site_id", "left")
    return df


def rule_zero_visits(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ, hours: int = 2) -> DataFrame:
    """Warn when an active, open site had no visit in the last hours; any recent visit resolves."""
    return (_active(t, live.recent_visits(t, as_of, hours)).withColumn("recent_count", F.coalesce("recent_count", F.lit(0)))
            .withColumn("r", _rules(as_of, tz)["zero_checkins"])
            .select("site_id", F.col("name").alias("site_name"), "recent_count", "r.*"))


def rule_capacity(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """Critical above 90 % of capacity, recovered below 85 %, unchanged between."""
    return (_active(t, live.occupancy(t)).withColumn("current_occupancy", F.coalesce("current_occupancy", F.lit(0)))
            .withColumn("r", _rules(as_of, tz)["capacity_breach"])
            .select("site_id", F.col("name").alias("site_name"), "current_occupancy", "capacity", "r.*",
                    rules.capacity_flags(F.col("current_occupancy"), F.col("capacity"))["pct"].alias("pct")))


def rule_revenue_drop(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """Warn when today so far is at most 70 % of the same weekday last week, recovered from 80 %."""
    total, before = F.col("today_total"), F.col("last_week_total")
    return (_active(t, live.revenue_totals(t, as_of, tz)).withColumns(live.zero_totals())
            .withColumn("r", _rules(as_of, tz)["revenue_drop"])
            .select("site_id", F.col("name").alias("site_name"), total.cast("double").alias("today_total"),
                    before.cast("double").alias("last_week_total"), "r.*",
                    rules.revenue_flags(total, before)["drop_pct"].alias("drop_pct")))


def rule_flags(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """Three rows per active site: type, severity, trigger, resolve, message. One join of the sites with the
    three measures, then one row per rule."""
    measured = (_active(t, live.recent_visits(t, as_of), live.occupancy(t), live.revenue_totals(t, as_of, tz))
                .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("recent_count", "current_occupancy")})
                .withColumns(live.zero_totals()))
    rows = [F.struct(F.lit(kind).alias("type"), F.lit(rules.SEVERITY[kind]).alias("severity"), verdict.alias("v"))
            for kind, verdict in _rules(as_of, tz).items()]
    return (measured.select("site_id", F.col("name").alias("site_name"), F.explode(F.array(*rows)).alias("r"))
            .select("site_id", "site_name", "r.type", "r.severity", "r.v.*"))


def anomaly_id(site_id, kind, detected_at):
    """Deterministic, so that a retried cycle writes the same id."""
    return F.sha2(F.concat_ws(":", site_id.cast("string"), kind, F.date_format(detected_at, "yyyy-MM-dd HH:mm:ss")), 256)


def actions(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """open / resolve / keep per active site and rule. A dismissed but unresolved anomaly blocks a new one."""
    is_open = (t.anomalies.filter(~F.col("resolved")).groupBy("site_id", "type")
               .agg(F.count(F.lit(1)).alias("open_count")))
    count = F.coalesce("open_count", F.lit(0))
    action = (F.when(F.col("trigger") & (count == 0), "open").when(F.col("resolve") & (count > 0), "resolve")
              .otherwise("keep"))
    return (rule_flags(t, as_of, tz).join(t.site_bounded(is_open, 3), ["site_id", "type"], "left")
            .withColumn("action", action))


def opened(acts: DataFrame, as_of: datetime) -> DataFrame:
    """New anomaly rows of this cycle, in the layout of the anomalies table."""
    now = tu.ts(as_of)
    return (acts.filter(F.col("action") == "open")
            .select(anomaly_id(F.col("site_id"), F.col("type"), now).alias("anomaly_id"), "site_id", "type", "severity",
                    "message", F.lit(False).alias("resolved"), F.lit(False).alias("dismissed"),
                    now.alias("detected_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at")))


def resolved(t: Tables, acts: DataFrame, as_of: datetime) -> DataFrame:
    """Every open anomaly whose rule has recovered, closed at `as_of`."""
    keys = acts.filter(F.col("action") == "resolve").select("site_id", "type")
    return (t.anomalies.filter(~F.col("resolved"))
            .join(t.site_bounded(keys, 3), ["site_id", "type"], "left_semi")
            .select(*t.anomalies.columns)
            .withColumn("resolved", F.lit(True)).withColumn("resolved_at", tu.ts(as_of)))


def detect_changes(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> DataFrame:
    """Only the rows of the log that one cycle adds or closes, to be appended or merged (anomalies.upsert_into); of the log itself the open rows are read."""
    acts = cut(actions(t, as_of, tz))
    return opened(acts, as_of).unionByName(resolved(t, acts, as_of).select(*t.anomalies.columns))


def detect_step(t: Tables, as_of: datetime, tz: str = DEFAULT_TZ) -> tuple[DataFrame, DataFrame]:
    """(anomalies after the cycle, change events). The rules are evaluated once; three rows a site are kept."""
    acts = cut(actions(t, as_of, tz))
    new, keys = opened(acts, as_of), acts.filter(F.col("action") == "resolve").select("site_id", "type", F.lit(True).alias("hit"))
    closing = F.col("hit").isNotNull() & ~F.col("resolved")
    after = (t.anomalies.join(t.site_bounded(keys, 3), ["site_id", "type"], "left")
             .withColumn("resolved_at", F.when(closing, tu.ts(as_of)).otherwise(F.col("resolved_at")))
             .withColumn("resolved", F.col("resolved") | closing)
             .select(*t.anomalies.columns).unionByName(new))
    events = (new.select(F.lit(EVENT_TYPES[3]).alias("type"), "site_id", "anomaly_id", F.col("type").alias("anomaly_type"),
                         "severity", "message", F.col("detected_at").alias("event_time"))
              .unionByName(resolved(t, acts, as_of).select(
                  F.lit(EVENT_TYPES[4]).alias("type"), "site_id", "anomaly_id", F.col("resolved_at").alias("event_time")),
                  allowMissingColumns=True))
    return after, events
