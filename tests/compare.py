"""Runs a query on Spark and its SQL on DuckDB over the same tables, and compares rows regardless of order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = Path(sf_dir, f"{table}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (bytearray, bytes)):
        return bytes(value)
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value


def rows_of(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree."""
    names, got = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    wanted_names, wanted = rows_of([c[0] for c in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if got == wanted:
        return ""
    return f"{got.total()} and {wanted.total()} rows; only Spark {list((got - wanted).items())[:3]}; only SQL {list((wanted - got).items())[:3]}"
