"""Run registered queries in Spark and their SQL in DuckDB on the same files and compare values.

Command line: python -m tests.oracle <folder> [name-part ...]
"""

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return value


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key), dict(df.dtypes)


def sql_rows(con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key), types


TYPE_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
              "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def differences(df, con, sql):
    """Empty list when columns, types and values agree."""
    cols, rows, types = spark_rows(df)
    sql_cols, expected, sql_types = sql_rows(con, sql)
    if cols != sql_cols:
        return [f"columns {cols} != {sql_cols}"], len(rows)
    out = [f"type of {c}: {types[c]} != {sql_types[c]}" for c in cols if TYPE_NAMES.get(types[c], types[c]) != sql_types[c]]
    if len(rows) != len(expected):
        out.append(f"{len(rows)} rows != {len(expected)}")
    out += [f"{a} != {b}" for a, b in zip(rows, expected) if a != b][:3]
    return out, len(rows)


if __name__ == "__main__":
    from sitemetrics.plans.all import ORACLES, QUERIES
    from sitemetrics.session import build_session

    folder, parts = sys.argv[1], sys.argv[2:]
    spark, con = build_session(), connect(folder)
    bad = 0
    for name, run in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            if name in ORACLES:
                problems, n = differences(run(spark, folder), con, ORACLES[name])
            else:
                problems, n = [], run(spark, folder).count()
        except Exception as error:  # noqa: BLE001
            problems, n = [f"{type(error).__name__}: {str(error)[:600]}"], -1
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {time.time() - begin:.2f}s" + "".join(f"\n     {p}" for p in problems),
              flush=True)
    print(f"{bad} failing")
