"""Spark's rows against DuckDB's."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return f"{float(x):.9g}" if abs(x) < 1 << 31 else x
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return x


def rows(names: list[str], found) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if names, types and rows agree, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, rel.fetchall())
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows: {only}"
    return None
