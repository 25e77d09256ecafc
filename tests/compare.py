"""Runs a query in Spark and its SQL in DuckDB and compares columns, types of value and rows."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty where both give the same."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    con = connect(sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; only in Spark {[x for x in got if x not in set(want)][:2]}; only in DuckDB {[x for x in want if x not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else ""
