"""Compare a query's Spark result with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{path}/*.parquet"):
        name = os.path.basename(file)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(value):
    """One text per value; kinds (int, float, text, date, timestamp) stay distinct."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        return f"f:{value!r}"
    if isinstance(value, decimal.Decimal):
        return f"d:{value.normalize():f}"
    if isinstance(value, dt.datetime):
        return f"t:{value.replace(tzinfo=None).isoformat()}"
    return f"{type(value).__name__}:{value}"


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    actual = rows_of(df.columns, df.collect())
    if actual == expected:
        return None
    only_a = [r for r in actual if r not in set(expected)][:3]
    only_e = [r for r in expected if r not in set(actual)][:3]
    return f"{len(actual)} rows, expected {len(expected)}; {sorted(columns)} spark {only_a} oracle {only_e}"
