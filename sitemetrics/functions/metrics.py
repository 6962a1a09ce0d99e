"""Scalar metrics as Column expressions."""

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemetrics import schemas
from sitemetrics.functions import timeutil as tu

# --- fixed values -----------------------------------------------------------------------------
# Hour-of-day traffic multiplier, local hours 0 to 23.
HOUR_WEIGHTS = [
    0.0, 0.0, 0.0, 0.0, 0.0, 0.3, 0.6, 1.0, 1.0, 1.0, 0.4, 0.4,
    0.3, 0.3, 0.2, 0.2, 0.2, 0.9, 0.9, 0.9, 0.9, 0.35, 0.35, 0.0,
]
# Day-of-week visit weight, Sunday first.
DOW_WEIGHTS = [0.45, 1.0, 0.95, 0.9, 0.95, 0.85, 0.7]
# Occupancy bands in percent, heat bands as share of the busiest cell.
BUSY_FROM, CRITICAL_ABOVE = 60, 85
HEAT_BANDS = [(0.25, "low"), (0.60, "medium"), (0.85, "high")]
# Activity badges; an unknown event type is shown as the first.
EVENT_LABELS = {"checkin": "IN", "checkout": "OUT", "payment": "PAID"}
# ----------------------------------------------------------------------------------------------


def pct(part, whole) -> Column:
    """100 * part / whole, one decimal, rounded half up on decimals."""
    part, whole = F.col(part) if isinstance(part, str) else part, F.col(whole) if isinstance(whole, str) else whole
    ratio = part.cast("decimal(20,2)") * F.lit(100) / whole.cast("decimal(20,2)")
    return F.round(ratio, 1).cast("double")


def capacity_pct(occupancy: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, pct(occupancy, capacity)).otherwise(F.lit(0.0))


def occupancy_band(percent: Column) -> Column:
    return (F.when(percent < BUSY_FROM, "NORMAL").when(percent <= CRITICAL_ABOVE, "BUSY").otherwise("CRITICAL"))


def churn_level(last_seen: Column, as_of: datetime, high: int = 45, critical: int = 60) -> Column:
    """CRITICAL / HIGH / NULL; both bounds strict, NULL activity is never at risk."""
    return (F.when(last_seen < tu.ts(as_of - timedelta(days=critical)), "CRITICAL")
            .when(last_seen < tu.ts(as_of - timedelta(days=high)), "HIGH"))


def days_absent(last_seen: Column, as_of: datetime) -> Column:
    """Whole elapsed 24-hour periods (not calendar days)."""
    return F.floor((tu.micros(tu.ts(as_of)) - tu.micros(last_seen)) / F.lit(86_400_000_000)).cast("int")


def contact(phone: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(phone, F.lit("")), email)


def duration_min(start: Column, end: Column) -> Column:
    """Minutes, rounded half away from zero; NULL while the visit is open."""
    return F.round(tu.seconds_between(start, end) / F.lit(60)).cast("int")


def plan_days(plan: Column) -> Column:
    """Length of the plan in days; unknown plans run as long as the longest one."""
    return (F.when(plan == "monthly", F.lit(schemas.PLAN_DAYS["monthly"]))
            .when(plan == "quarterly", F.lit(schemas.PLAN_DAYS["quarterly"]))
            .otherwise(F.lit(schemas.PLAN_DAYS["annual"])))


def plan_price(plan: Column) -> Column:
    price = F.create_map(*[F.lit(x) for item in schemas.PLAN_PRICE.items() for x in item])
    return F.coalesce(F.try_element_at(price, plan), F.lit(schemas.DEFAULT_PRICE))


def plan_expiry(joined: Column, plan: Column) -> Column:
    return joined + F.make_dt_interval(days=plan_days(plan))


def traffic_multiplier(moment: Column, tz: str = tu.DEFAULT_TZ) -> Column:
    weights = F.array(*[F.lit(w) for w in HOUR_WEIGHTS])
    return F.element_at(weights, F.hour(tu.to_local(moment, tz)) + 1)


def visit_weight(day: Column) -> Column:
    weights = F.array(*[F.lit(w) for w in DOW_WEIGHTS])
    return F.element_at(weights, tu.dow0(day) + 1)


def heat_band(count: Column, peak: Column) -> Column:
    share = count / peak
    band = F.when(count == 0, "none")
    for bound, label in HEAT_BANDS:
        band = band.when(share < bound, label)
    return band.otherwise("peak")


def event_label(event_type: Column) -> Column:
    first, *rest = EVENT_LABELS.items()
    label = F.when(event_type == first[0], first[1])
    for kind, text in rest:
        label = label.when(event_type == kind, text)
    return label.otherwise(first[1])


def lookup(values: list[str], index: Column) -> Column:
    """values[index mod size], zero based."""
    items = F.array(*[F.lit(v) for v in values])
    return F.element_at(items, (F.pmod(index, F.size(items)) + 1).cast("int"))
