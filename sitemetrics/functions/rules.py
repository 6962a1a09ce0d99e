"""The three anomaly rules as Column expressions; thresholds compare unrounded values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemetrics.functions import metrics

# --- fixed values: thresholds in percent, severities, message texts ---------------------------
BREACH_ABOVE, RECOVER_BELOW = 90, 85
DROP_AT_OR_BELOW, RECOVER_AT_OR_ABOVE = 70, 80
SEVERITY = {"zero_checkins": "warning", "capacity_breach": "critical", "revenue_drop": "warning"}
ZERO_MESSAGE = "Zero check-ins recorded in the last 2 hours during operating hours at %s."
CAPACITY_MESSAGE = "Capacity breach detected at %s! Occupancy is at %s%% (%d/%d)."
REVENUE_MESSAGE = "Significant revenue drop detected at %s. Revenue today is down %s%% vs last week."
# ----------------------------------------------------------------------------------------------


def zero_visits_trigger(status: Column, is_open: Column, recent: Column) -> Column:
    return (status == "active") & is_open & (recent == 0)


def capacity_flags(occupancy: Column, capacity: Column) -> Column:
    """struct(trigger, resolve, pct); capacity NULL or <= 0 gives neither flag."""
    usable = F.coalesce(capacity > 0, F.lit(False))
    load = occupancy.cast("long") * 100
    return F.struct(
        F.when(usable, load > capacity * BREACH_ABOVE).otherwise(F.lit(False)).alias("trigger"),
        F.when(usable, load < capacity * RECOVER_BELOW).otherwise(F.lit(False)).alias("resolve"),
        F.when(usable, metrics.pct(occupancy, capacity)).alias("pct"),
    )


def capacity_mark(occupancy: Column, capacity: Column) -> Column:
    """The capacity rule's mark alone, for row-level replay."""
    load = occupancy * 100
    return F.when(capacity > 0, mark(load > capacity * BREACH_ABOVE, load < capacity * RECOVER_BELOW))


def revenue_flags(today: Column, last_week: Column) -> Column:
    """struct(trigger, resolve, drop_pct); no positive baseline gives neither flag."""
    today, last_week = today.cast("decimal(20,2)"), last_week.cast("decimal(20,2)")
    usable = F.coalesce(last_week > 0, F.lit(False))
    return F.struct(
        F.when(usable, today * 100 <= last_week * DROP_AT_OR_BELOW).otherwise(F.lit(False)).alias("trigger"),
        F.when(usable, today * 100 >= last_week * RECOVER_AT_OR_ABOVE).otherwise(F.lit(False)).alias("resolve"),
        F.when(usable, metrics.pct(last_week - today, last_week)).alias("drop_pct"),
    )


def mark(trigger: Column, resolve: Column) -> Column:
    """1 opens, 0 closes, NULL keeps the state: the state is the last non-null mark."""
    return F.when(trigger, 1).when(resolve, 0)


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", value)
