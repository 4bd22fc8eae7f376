"""Side-by-side comparison of a query and its SQL over the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal, float)):
        f = float(x)
        return "nan" if math.isnan(f) else round(f, 6)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    return x


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sql: str, sf_dir: str = SF_DIR) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return cols, cur.fetchall()


def difference(df, sql: str, sf_dir: str = SF_DIR, *, may_be_empty: bool = False) -> str | None:
    """None if a query and its SQL agree, else the first rows that differ. No rows at all are no agreement, unless that is said."""
    cols, want = oracle_rows(sql, sf_dir)
    if not want and not may_be_empty:
        return "the SQL gives no rows"
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    got, want = normal(df.columns, df.collect()), normal(cols, want)
    if got == want:
        return None
    left, right = set(got), set(want)
    only_got, only_want = [r for r in got if r not in right][:3], [r for r in want if r not in left][:3]
    return f"{len(got)} rows against {len(want)}; ours {only_got}; SQL's {only_want}"
