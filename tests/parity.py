"""Compares registered queries with their oracles in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return float(x) + 0.0
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_value(r[i]) for i in order] for r in data), key=lambda r: [(v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v if v is not None else 0) for v in r])


def difference(df, con, sql: str) -> str | None:
    """What differs, if anything does."""
    got, found = df.columns, con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(got) != sorted(names):
        return f"columns {sorted(got)} and {sorted(names)}"
    a, b = rows(got, [tuple(r) for r in df.collect()]), rows(names, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    for x, y in zip(a, b):
        if any(p != q and not (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-6 * max(1, abs(q))) for p, q in zip(x, y)):
            return f"{x} and {y}"
    return None
