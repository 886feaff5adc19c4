"""Compare a query with its SQL: names, row count and values, in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (value + 0.0 if value else 0.0)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and the SQL result, or None."""
    got_names, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_names, want = _sorted([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not got:
        return "no rows"
    off = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(off)} of {len(got)} rows differ, first {off[0]}" if off else None
