"""Replay of the rules over history.

A trigger while open and a resolve while closed change nothing, so the state after each step is the last
non-null mark; windows express it without a state machine. To keep a busy site out of a single task, every
scan runs inside (site, time block), the blocks are chained by a window over their one-row summaries, and
the carry is joined back. Blocks are fixed time intervals, so a recomputed task finds the same blocks.
"""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.functions import rules
from sitemetrics.functions import timeutil as tu
from sitemetrics.functions.timeutil import DEFAULT_TZ
from sitemetrics.session import cut

# A site's rows of one block share a task; its blocks share one only as one-row summaries.
BLOCK = timedelta(minutes=15)


def _block(moment: Column, size: timedelta) -> Column:
    return F.floor(tu.micros(moment) / F.lit(int(size.total_seconds() * 1_000_000))).cast("long")


def visit_deltas(visits: DataFrame, *more: str) -> DataFrame:
    """Occupancy changes of visits: one in at the start and, where the end is known, one out. `more`: further columns to keep."""
    ident = F.col("visit_id").cast("string")

    def change(name, at, delta):
        return F.struct(F.concat(ident, F.lit(name)).alias("event_id"), F.col(at).alias("event_time"), F.lit(delta).alias("delta"))
    ends = F.array(change("-in", "checked_in", 1), change("-out", "checked_out", -1))
    return (visits.select("site_id", *more, F.explode(ends).alias("e")).select("site_id", *more, "e.*").filter(F.col("event_time").isNotNull()))


def steps(deltas: DataFrame, block: timedelta = BLOCK) -> DataFrame:
    """Rows with their block, the running sum s inside it and its running minimum m.

    From an occupancy x at a block's start, the occupancy inside it is s + max(x, -m).
    """
    order = (Window.partitionBy("site_id", "block").orderBy("event_time", "event_id")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The explicit null filter keeps both uses of `steps` identical, so their row shuffle is done once.
    return (deltas.withColumn("block", _block(F.col("event_time"), block))
            .filter(F.col("site_id").isNotNull() & F.col("block").isNotNull())
            .withColumn("s", F.sum("delta").over(order))
            .withColumn("m", F.min("s").over(order)))


def summaries(stepped: DataFrame) -> DataFrame:
    """Blocks as functions of the occupancy x before them: x -> net + max(x, -low)."""
    return stepped.groupBy("site_id", "block").agg(F.sum("delta").alias("net"), F.min("s").alias("low"))


def chained(whole: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(site_id, block, net, low, carry, after): occupancy before and after each block, by a scan over one-row summaries.

    Such functions compose: net adds up, and the lowest running sum decides the clamp. `start`: site_id, occupancy before the
    first row (absent sites: 0).
    """
    if start is None:
        whole = whole.withColumn("x", F.lit(0).cast("long"))
    else:
        first = start.select("site_id", F.col("occupancy").cast("long").alias("x"))
        whole = whole.join(first, "site_id", "left").withColumn("x", F.coalesce("x", F.lit(0)))
    chain = Window.partitionBy("site_id").orderBy("block")
    upto = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (whole.withColumn("end", F.sum("net").over(upto))
            .withColumn("lowest", F.min(F.col("end") - F.col("net") + F.col("low")).over(upto))
            .withColumn("after", F.col("end") + F.greatest(F.col("x"), -F.col("lowest")))
            .select("site_id", "block", "net", "low", F.coalesce(F.lag("after").over(chain), F.col("x")).alias("carry"), "after"))


def _filled(stepped: DataFrame, blocks: DataFrame, *more: str) -> DataFrame:
    return (stepped.join(blocks.select("site_id", "block", "carry", *more), ["site_id", "block"])
            .select("site_id", "block", "event_time", "event_id",
                    (F.col("s") + F.greatest(F.col("carry"), -F.col("m"))).alias("occupancy"), *more))


def occupancy_timeline(deltas: DataFrame, block: timedelta = BLOCK, start: DataFrame | None = None) -> DataFrame:
    """Occupancy after every delta of a site, never below zero: occ = max(0, occ + delta) in time order.

    Input: site_id, event_time, event_id, delta.
    """
    stepped = steps(deltas, block)
    return _filled(stepped, chained(summaries(stepped), start))


def mark_runs(marked: DataFrame) -> DataFrame:
    """Rows of (site_id, block, event_time, event_id, mark, ...) where the mark differs from the one before it
    in the block; the first mark of a block always stays. Everything later works on these few rows."""
    inside = Window.partitionBy("site_id", "block").orderBy("event_time", "event_id")
    return (marked.filter(F.col("mark").isNotNull()).withColumn("before", F.lag("mark").over(inside))
            .filter(F.col("before").isNull() | (F.col("before") != F.col("mark"))))


def transitions(runs: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """State changes: runs that differ from the site's state before them. Sites start closed, or as `start`
    (site_id, is_open) says."""
    last = (runs.groupBy("site_id", "block")
            .agg(F.max_by("mark", F.struct("event_time", "event_id")).alias("last_mark")))
    if start is None:
        last = last.withColumn("initial", F.lit(0))
    else:
        state = start.select("site_id", F.col("is_open").cast("int").alias("initial"))
        last = last.join(state, "site_id", "left").withColumn("initial", F.coalesce("initial", F.lit(0)))
    chain = Window.partitionBy("site_id").orderBy("block")
    carried = last.select("site_id", "block", F.coalesce(F.lag("last_mark").over(chain), F.col("initial")).alias("carry"))
    return (runs.join(carried, ["site_id", "block"])
            .filter(F.coalesce("before", "carry") != F.col("mark"))
            .drop("before", "carry"))


def episodes(changes: DataFrame) -> DataFrame:
    """Pair every opening with the change that follows it; NULL end = still open."""
    inside = Window.partitionBy("site_id", "block").orderBy("event_time", "event_id")
    first = changes.groupBy("site_id", "block").agg(F.min("event_time").alias("first_at"))
    chain = Window.partitionBy("site_id").orderBy("block")
    following = first.select("site_id", "block", F.lead("first_at").over(chain).alias("next_block_at"))
    return (changes.withColumn("next_at", F.lead("event_time").over(inside))
            .join(following, ["site_id", "block"])
            .withColumn("closed_at", F.coalesce("next_at", "next_block_at"))
            .filter(F.col("mark") == 1)
            .drop("next_at", "next_block_at", "mark", "block"))


def marked_runs(stepped: DataFrame, blocks: DataFrame, capacity: DataFrame) -> DataFrame:
    """Runs of the capacity rule's marks. Capacity meets the blocks, one row each, and reaches the rows with the carry."""
    known = blocks.join(capacity.select("site_id", F.col("capacity").cast("long").alias("capacity")), "site_id")
    rows = _filled(stepped, known, "capacity")
    return mark_runs(rows.withColumn("mark", rules.capacity_mark(F.col("occupancy"), F.col("capacity"))).drop("capacity"))


def capacity_transitions(deltas: DataFrame, capacity: DataFrame, block: timedelta = BLOCK) -> DataFrame:
    """Every opening (mark 1) and closing (mark 0) of the capacity rule. `capacity`: site_id, capacity."""
    stepped = steps(deltas, block)
    # The row-level scan runs once; its compressed result is read twice below.
    return transitions(cut(marked_runs(stepped, chained(summaries(stepped)), capacity)))


CAPACITY_STATE = "site_id int, occupancy bigint, is_open boolean"


def capacity_advance(stored: DataFrame, arrived: DataFrame, capacity: DataFrame,
                     block: timedelta = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(changes, new state) after the rows of one drain, which are newer than all earlier ones.

    `stored`: site_id, occupancy, is_open. The same segmented scan as the replay, continued from the stored
    state, so a busy site is still spread over its blocks. Rows of any age go through streaming.capacity.
    """
    stepped = steps(arrived, block)
    blocks = cut(chained(summaries(stepped), stored))
    changes = transitions(cut(marked_runs(stepped, blocks, capacity)), stored)
    occupancy = blocks.groupBy("site_id").agg(F.max_by("after", "block").alias("now_occupancy"))
    state = changes.groupBy("site_id").agg((F.max_by("mark", F.struct("event_time", "event_id")) == 1).alias("now_open"))
    new = (stored.join(occupancy, "site_id", "full").join(state, "site_id", "left")
           .select("site_id", F.coalesce("now_occupancy", "occupancy").alias("occupancy"),
                   F.coalesce("now_open", "is_open", F.lit(False)).alias("is_open")))
    return changes, new


def capacity_episodes(deltas: DataFrame, capacity: DataFrame, block: timedelta = BLOCK) -> DataFrame:
    """Capacity breaches over history: opening time and occupancy, closing time (NULL = open)."""
    found = episodes(capacity_transitions(deltas, capacity, block))
    return found.select("site_id", F.col("event_time").alias("opened_at"), F.col("occupancy").alias("opened_occupancy"),
                        "closed_at")


def daily_revenue(payments: DataFrame, sites: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Revenue per site and local day, zero-filled from the first to the last day of the table."""
    days = (payments.groupBy("site_id", tu.quarter("paid_at").alias("quarter")).agg(F.sum("amount").alias("part"))
            .groupBy("site_id", tu.local_date(F.col("quarter"), tz).alias("day")).agg(F.sum("part").alias("revenue")))
    return fill_days(days, sites)


def fill_days(days: DataFrame, sites: DataFrame) -> DataFrame:
    """Zero-fill (site_id, day, revenue) over the common span of days."""
    # One row a site and day, read for the span and again for the join.
    days = cut(days)
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if span.lo is None:
        return days
    spine = sites.select("site_id", F.explode(F.sequence(F.lit(span.lo), F.lit(span.hi))).alias("day"))
    return (spine.join(days, ["site_id", "day"], "left")
            .withColumn("revenue", F.coalesce("revenue", F.lit(0).cast("decimal(22,2)"))))


def revenue_drop_history(daily: DataFrame) -> DataFrame:
    """The revenue rule at the end of every local day: totals, mark and state. `daily` has a row for each day.

    One row a site and day, so a window over a site's days is small.
    """
    by_day = Window.partitionBy("site_id").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flags = rules.revenue_flags(F.col("revenue"), F.col("week_before"))
    return (daily.withColumn("week_before", F.lag("revenue", 7).over(by_day)).withColumn("f", flags)
            .withColumn("mark", rules.mark(F.col("f.trigger"), F.col("f.resolve")))
            .select("site_id", "day", F.col("revenue").cast("double").alias("revenue"),
                    F.col("week_before").cast("double").alias("week_before"), F.col("f.drop_pct").alias("drop_pct"),
                    F.coalesce(F.last("mark", ignorenulls=True).over(so_far) == 1, F.lit(False)).alias("is_open")))


def zero_visit_history(visits: DataFrame, sites: DataFrame, tz: str = DEFAULT_TZ,
                       look_back: timedelta = timedelta(hours=2), step: timedelta = timedelta(minutes=30)) -> DataFrame:
    """Probe points at which an active, open site had no visit in [probe - look_back, probe].

    Visits are counted into the first and last probe they belong to before the fan-out, so the shuffle carries
    one row per site and step. Probes run from the first step at which a full look-back lies in the data.
    """
    width, back = int(step.total_seconds()) * 1_000_000, int(look_back.total_seconds()) * 1_000_000
    at = tu.micros(F.col("checked_in"))
    first, last = F.ceil(at / F.lit(width)).cast("long"), F.floor((at + back) / F.lit(width)).cast("long")
    # At most two rows a site and step; read for the span and again for the probes.
    slots = cut(visits.select("site_id", first.alias("p0"), last.alias("p1"), at.alias("at")).groupBy("site_id", "p0", "p1")
                .agg(F.min("at").alias("from_at"), F.max("at").alias("to_at")))
    seen = slots.select("site_id", F.explode(F.sequence("p0", "p1")).alias("probe")).distinct()
    span = slots.agg(F.ceil((F.min("from_at") + back) / F.lit(width)).cast("long").alias("lo"),
                     F.floor(F.max("to_at") / F.lit(width)).cast("long").alias("hi")).first()
    if span.lo is None or span.lo > span.hi:
        return visits.sparkSession.createDataFrame([], "site_id int, probe_at timestamp_ntz")
    probes = (sites.filter(F.col("status") == "active")
              .select("site_id", "opens_min", "closes_min",
                      F.explode(F.sequence(F.lit(span.lo), F.lit(span.hi))).alias("probe"))
              .withColumn("probe_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
                          + F.make_dt_interval(secs=F.col("probe") * int(step.total_seconds()))))
    minute = tu.minute_of_day(tu.to_local(F.col("probe_at"), tz))
    open_now = (F.col("opens_min") < minute) & (F.col("closes_min") >= minute)
    return (probes.filter(open_now).join(seen, ["site_id", "probe"], "left_anti").select("site_id", "probe_at"))
