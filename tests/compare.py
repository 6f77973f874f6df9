"""Row-by-row comparison of a Spark query with its SQL twin."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return float(v) + 0.0 if not isinstance(v, str) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    theirs = con.execute(sql)
    their_cols = [d[0] for d in theirs.description]
    expected = rows_of(their_cols, theirs.fetchall())
    if sorted(df.columns) != sorted(their_cols):
        return f"columns {sorted(df.columns)} != {sorted(their_cols)}"
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows != {len(expected)}"
    bad = [(a, b) for a, b in zip(found, expected) if repr(a) != repr(b)]
    return f"{len(bad)} of {len(found)} rows differ, first {bad[0]}" if bad else None
