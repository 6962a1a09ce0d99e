"""Declared schemas of the five tables, the derived hourly table and the event envelope.

Timestamps are UTC wall clocks stored as TIMESTAMP_NTZ, so no result depends on the session zone.
"""

from pyspark.sql import types as T

_ts = T.TimestampNTZType()

SITES = T.StructType([
    T.StructField("site_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("capacity", T.IntegerType()),
    T.StructField("opens_min", T.IntegerType()),
    T.StructField("closes_min", T.IntegerType()),
    T.StructField("address", T.StringType()),
    T.StructField("created_at", _ts),
    T.StructField("updated_at", _ts),
])

MEMBERS = T.StructType([
    T.StructField("member_id", T.LongType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("plan_type", T.StringType()),
    T.StructField("member_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("joined_at", _ts),
    T.StructField("plan_expires_at", _ts),
    T.StructField("last_checkin_at", _ts),
    T.StructField("created_at", _ts),
])

VISITS = T.StructType([
    T.StructField("visit_id", T.LongType()),
    T.StructField("member_id", T.LongType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("checked_in", _ts),
    T.StructField("checked_out", _ts),
])

PAYMENTS = T.StructType([
    T.StructField("payment_id", T.LongType()),
    T.StructField("member_id", T.LongType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("amount", T.DecimalType(12, 2)),
    T.StructField("plan_type", T.StringType()),
    T.StructField("payment_type", T.StringType()),
    T.StructField("paid_at", _ts),
    T.StructField("notes", T.StringType()),
])

ANOMALIES = T.StructType([
    T.StructField("anomaly_id", T.StringType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("resolved", T.BooleanType()),
    T.StructField("dismissed", T.BooleanType()),
    T.StructField("detected_at", _ts),
    T.StructField("resolved_at", _ts),
])

HOURLY_STATS = T.StructType([
    T.StructField("site_id", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("checkin_count", T.IntegerType()),
])

# One envelope for the five message types; fields that a type does not carry stay NULL.
ENVELOPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("site_name", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("member_id", T.LongType()),
    T.StructField("member_name", T.StringType()),
    T.StructField("current_occupancy", T.LongType()),
    T.StructField("capacity_pct", T.DoubleType()),
    T.StructField("amount", T.DecimalType(12, 2)),
    T.StructField("plan_type", T.StringType()),
    T.StructField("today_total", T.DecimalType(22, 2)),
    T.StructField("anomaly_id", T.StringType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("resolved_at", T.StringType()),
])

# --- fixed values: enum domains, column defaults, plan lengths and prices ---------------------
SITE_STATUS = ["active", "inactive", "maintenance"]
MEMBER_STATUS = ["active", "inactive", "frozen"]
PLAN_TYPES = ["monthly", "quarterly", "annual"]
MEMBER_TYPES = ["new", "renewal"]
PAYMENT_TYPES = ["new", "renewal"]
ANOMALY_TYPES = ["zero_checkins", "capacity_breach", "revenue_drop"]
SEVERITIES = ["warning", "critical"]
EVENT_TYPES = ["CHECKIN_EVENT", "CHECKOUT_EVENT", "PAYMENT_EVENT", "ANOMALY_DETECTED", "ANOMALY_RESOLVED"]
# Fields that a message of each type must carry.
REQUIRED = {
    "CHECKIN_EVENT": ["event_id", "site_id", "event_time", "member_id", "current_occupancy"],
    "CHECKOUT_EVENT": ["event_id", "site_id", "event_time", "member_id", "current_occupancy"],
    "PAYMENT_EVENT": ["event_id", "site_id", "event_time", "member_id", "amount", "plan_type", "today_total"],
    "ANOMALY_DETECTED": ["event_id", "site_id", "event_time", "anomaly_id", "anomaly_type", "severity", "message"],
    "ANOMALY_RESOLVED": ["event_id", "site_id", "event_time", "anomaly_id", "resolved_at"],
}
PLAN_DAYS = {"monthly": 30, "quarterly": 90, "annual": 365}
PLAN_PRICE = {"monthly": 1499, "quarterly": 3999, "annual": 11999}
DEFAULT_PRICE = 1499
DEFAULTS = {
    "sites": {"status": "active", "opens_min": 360, "closes_min": 1320},
    "members": {"member_type": "new", "status": "active"},
    "visits": {},
    "payments": {"payment_type": "new"},
    "anomalies": {"resolved": False, "dismissed": False},
}
# ----------------------------------------------------------------------------------------------

TABLES = {"sites": SITES, "members": MEMBERS, "visits": VISITS, "payments": PAYMENTS, "anomalies": ANOMALIES}
