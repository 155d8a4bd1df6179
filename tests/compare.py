"""Run a registered query in Spark and its statement in DuckDB, and compare all rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def duck(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{path}/*.parquet"):
        name = os.path.basename(file)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return v
    return repr(float(v)) if isinstance(v, int) else str(v)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == expected:
        return None
    more, less = got - expected, expected - got
    return (f"{sum(got.values())} rows, expected {sum(expected.values())}; "
            f"{sum(more.values())} wrong such as {list(more)[:2]}, "
            f"{sum(less.values())} missing such as {list(less)[:2]}")
