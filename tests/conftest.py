from datetime import datetime
from decimal import Decimal

import pytest

from sitemetrics import schemas
from sitemetrics.session import build_session
from sitemetrics.sources.tables import Tables


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """make("visits", [{...}, ...]) -> DataFrame in the declared schema; absent fields are NULL."""
    def build(table, rows):
        schema = schemas.TABLES[table]
        return spark.createDataFrame([tuple(r.get(c) for c in schema.fieldNames()) for r in rows], schema)
    return build


NOW = datetime(2024, 3, 15, 12, 0)   # 17:30 local


@pytest.fixture(scope="session")
def small(make):
    """Three sites in the three planted states and a fourth in maintenance."""
    def at(day, hour, minute=0):
        return datetime(2024, 3, day, hour, minute)
    site = dict(city="X", status="active", opens_min=360, closes_min=1320)
    sites = [dict(site, site_id=1, name="Alpha zero", capacity=10), dict(site, site_id=2, name="Beta breach", capacity=4),
             dict(site, site_id=3, name="Gamma drop", capacity=10), dict(site, site_id=4, name="Delta", capacity=5,
                                                                         status="maintenance")]
    member = dict(plan_type="monthly", member_type="new", status="active", joined_at=datetime(2024, 1, 1),
                  plan_expires_at=datetime(2024, 1, 31))
    members = [dict(member, member_id=i, site_id=1 + i % 3, name=f"m{i}", email=f"m{i}@x.org", phone=f"9{i:09d}",
                    last_checkin_at=at(15, 11)) for i in range(1, 13)]
    visits = [dict(visit_id=1, member_id=3, site_id=1, checked_in=at(15, 9, 0), checked_out=at(15, 10, 0))]
    visits += [dict(visit_id=10 + i, member_id=1 + 3 * i, site_id=2, checked_in=at(15, 11), checked_out=None) for i in range(4)]
    visits += [dict(visit_id=20, member_id=2, site_id=3, checked_in=at(15, 11), checked_out=None)]
    payments = [dict(payment_id=i, member_id=i, site_id=1 + i % 3, amount=Decimal("1499.00"), plan_type="monthly",
                     payment_type="new", paid_at=datetime(2024, 1, 1)) for i in range(1, 13)]
    payments += [dict(payment_id=100 + i, member_id=2, site_id=3, amount=Decimal("3999.00"), plan_type="quarterly",
                      payment_type="new", paid_at=at(8, 5, i)) for i in range(8)]
    return Tables(make("sites", sites), make("members", members), make("visits", visits), make("payments", payments),
                  make("anomalies", []))
