"""Spark results against DuckDB SQL: rows as multisets, floats rounded."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return str(x) if hasattr(x, "isoformat") else x


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def expected(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.execute(sql)
    columns = [d[0] for d in r.description]
    return sorted(columns), rows_of(columns, r.fetchall())


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if the frame has the rows of the SQL."""
    names, want = expected(sql, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return ""
