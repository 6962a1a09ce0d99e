"""First loads that are guarded: a table becomes current only when it was written whole and is not short."""

from pyspark.sql import DataFrame, SparkSession

from sitemetrics import schemas
from sitemetrics.sources.store import ShortLoad, Versions
from sitemetrics.sources.tables import Tables, with_defaults


def table_versions(spark: SparkSession, folder: str, table: str) -> Versions:
    return Versions(spark, f"{folder}/{table}", schemas.TABLES[table])


def load(versions: Versions, df: DataFrame, least: int = 1) -> tuple[str, int]:
    """('loaded', rows), or ('refused', rows that stay current) for fewer than `least` rows; defaults are filled in."""
    table = versions.root.rsplit("/", 1)[1]
    missing = [f for f in versions.schema if f.name not in df.columns]
    full = df.selectExpr("*", *[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in missing])
    try:
        return "loaded", versions.write(with_defaults(full, table), versions.current(), least=least).rows
    except ShortLoad:
        return "refused", versions.current().rows


def load_all(spark: SparkSession, folder: str, tables: Tables, least: int = 1) -> list[tuple[str, str, int]]:
    """(table, outcome, rows) of a load of the bundle."""
    return [(name, *load(table_versions(spark, folder, name), getattr(tables, name), least))
            for name in schemas.TABLES if getattr(tables, name) is not None]


def read_all(spark: SparkSession, folder: str) -> Tables:
    return Tables(*[table_versions(spark, folder, name).read() for name in schemas.TABLES])
