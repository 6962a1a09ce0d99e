"""Named queries over the supplied tables, each with an equivalent SQL text where SQL can state it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitemetrics.plans.fixture_sql import with_ctes
from sitemetrics.session import configure
from sitemetrics.sources.fixtures import Fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_fixtures: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, folder: str) -> Fixture:
    """Adapted tables of a folder; the plans (not the data) are kept for the life of the session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _fixtures:
        _fixtures[key] = Fixture(configure(spark), folder)
    return _fixtures[key]



def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a function of a Fixture under `name`."""
    def register(build: Callable[[Fixture], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: build(fixture(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, extra)
        return build
    return register
