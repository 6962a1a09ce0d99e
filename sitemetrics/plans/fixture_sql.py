"""The fixture adapters once more, as SQL common table expressions for the oracle queries.

`*_all` are whole tables; `visits`, `payments`, `anomalies` are rewound to the live clock.
"""

import re

NOW = "TIMESTAMP '2024-01-30 12:00:00'"
LEDGER_NOW = "TIMESTAMP '2001-06-01 00:00:00'"
# Local midnights (zone +05:30) of the two clocks, as UTC.
DAY = "TIMESTAMP '2024-01-29 18:30:00'"
LEDGER_DAY = "TIMESTAMP '2001-05-31 18:30:00'"
IST = "INTERVAL '330 minutes'"

_PLAN = "case {0} % 3 when 0 then 'monthly' when 1 then 'quarterly' else 'annual' end"
_DAYS = "case {0} % 3 when 0 then 30 when 1 then 90 else 365 end"

CTES = {
    "sites": """
select n_nationkey as site_id, n_name as name, r_name as city,
  case when n_nationkey % 10 = 9 then 'maintenance' else 'active' end as status,
  cast(floor((coalesce(cnt, 0) * (12 + n_nationkey % 9) + 9) / 10) as integer) as capacity,
  300 + 30 * (n_nationkey % 3) as opens_min, 1260 + 30 * (n_nationkey % 4) as closes_min
from nation join region on r_regionkey = n_regionkey
left join (select c_nationkey as k, count(*) as cnt from customer group by c_nationkey) q on k = n_nationkey""",
    "visits_all": """
select event_id as visit_id, user_id as member_id, cast(user_id % 25 as integer) as site_id, ts as checked_in,
  case when event_type = 'signup' then cast(null as timestamp)
       else ts + (2700 + event_id % 2701) * INTERVAL '1 second' end as checked_out
from events where event_type in ('view', 'click', 'signup')""",
    "visits": f"""
select visit_id, member_id, site_id, checked_in, case when checked_out <= {NOW} then checked_out end as checked_out
from visits_all where checked_in <= {NOW}""",
    "payments_all": f"""
select event_id as payment_id, user_id as member_id, cast(user_id % 25 as integer) as site_id,
  cast(value as decimal(12,2)) as amount, {_PLAN.format('event_id')} as plan_type,
  case when event_id % 5 = 0 then 'renewal' else 'new' end as payment_type, ts as paid_at
from events where event_type = 'purchase'""",
    "payments": f"select * from payments_all where paid_at <= {NOW}",
    "ledger": """
select o_orderkey as payment_id, o_custkey as member_id, c_nationkey as site_id,
  cast(o_totalprice as decimal(12,2)) as amount, o_orderpriority as plan_type,
  case when o_orderstatus = 'F' then 'renewal' else 'new' end as payment_type, o_orderdate as paid_at
from orders join customer on c_custkey = o_custkey""",
    "members": f"""
select c_custkey as member_id, c_nationkey as site_id, c_name as name,
  case when c_custkey % 7 = 0 then ''
       else concat(cast(7 + c_custkey % 3 as varchar), lpad(cast(c_custkey as varchar), 9, '0')) end as phone,
  lower(concat(c_name, '@example.com')) as email, {_PLAN.format('c_custkey')} as plan_type,
  case when c_custkey % 5 = 0 then 'renewal' else 'new' end as member_type,
  case c_custkey % 10 when 0 then 'inactive' when 1 then 'frozen' else 'active' end as status,
  {LEDGER_NOW} - (c_custkey % 400) * INTERVAL '1 day' as joined_at,
  {LEDGER_NOW} - (c_custkey % 400) * INTERVAL '1 day'
    + ({_DAYS.format('c_custkey')} + case when c_custkey % 50 = 0 then 1 else 0 end) * INTERVAL '1 day' as plan_expires_at,
  l.last_at as last_checkin_at
from customer left join (select o_custkey as k, max(o_orderdate) as last_at from orders
  where o_orderdate < {LEDGER_NOW} group by o_custkey) l on l.k = c_custkey""",
    "members_live": """
select member_id, site_id, name, phone, email, plan_type, member_type, status,
  joined_at + INTERVAL '198684 hours' as joined_at, plan_expires_at + INTERVAL '198684 hours' as plan_expires_at,
  last_checkin_at + INTERVAL '198684 hours' as last_checkin_at
from members""",
    "errors": """
select event_id, ts, cast(user_id % 25 as integer) as site_id,
  case event_id % 3 when 0 then 'zero_checkins' when 1 then 'capacity_breach' else 'revenue_drop' end as type
from events where event_type = 'error'""",
    "anomalies_all": """
select cast(event_id as varchar) as anomaly_id, e.site_id, e.type,
  case when event_id % 3 = 1 then 'critical' else 'warning' end as severity,
  e.type || ' #' || cast(event_id as varchar) as message,
  event_id <> last_id or event_id % 2 = 0 as resolved, event_id % 3 <> 1 and event_id % 4 = 0 as dismissed,
  ts as detected_at,
  case when event_id <> last_id or event_id % 2 = 0 then ts + (event_id % 60 + 5) * INTERVAL '1 minute' end as resolved_at
from errors e join (select site_id, type, max(event_id) as last_id from errors group by site_id, type) m
  on m.site_id = e.site_id and m.type = e.type""",
    "anomalies": f"""
select anomaly_id, site_id, type, severity, message, coalesce(resolved and resolved_at <= {NOW}, false) as resolved,
  dismissed, detected_at, case when resolved and resolved_at <= {NOW} then resolved_at end as resolved_at
from anomalies_all where detected_at <= {NOW}""",
    "deltas": """
select site_id, cast(visit_id as varchar) || '-in' as event_id, checked_in as event_time, 1 as delta from visits_all
union all select site_id, cast(visit_id as varchar) || '-out', checked_out, -1 from visits_all where checked_out is not null""",
}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `body` with the common table expressions it mentions, directly or through others."""
    ctes = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in ctes.items():
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", text, re.I):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    head = ",\n".join(f"{name} as ({ctes[name].strip()})" for name in needed)
    return f"with {head}\n{body.strip()}"
