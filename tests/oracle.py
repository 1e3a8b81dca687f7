"""Compare queries with their SQL in DuckDB, column by column, without regard to row order."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, (int,)):
        return float(x) if abs(x) < 1 << 53 else x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x if isinstance(x, str) else float(x) if hasattr(x, "__float__") else x


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got, want = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    if got == want:
        return ""
    a, b = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return f"{len(got)} and {len(want)} rows; only Spark {a}; only SQL {b}"
