"""Runs a query and its SQL twin over one directory of tables and compares names, counts and values."""

import glob
import math
import os
from datetime import date, datetime

import duckdb

from skerry.session import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if hasattr(v, "quantize"):
        return round(float(v), 4)
    return v


def difference(df, con, sql):
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {got[:2]} {want[:2]}"
    for a, b in zip(got, want, strict=True):
        if any(x != y and not (isinstance(x, float | int) and isinstance(y, float | int) and abs(x - y) <= 1.01e-4 * max(1, abs(x))) for x, y in zip(a, b, strict=True)):
            return f"{order}: {a} and {b}"
    return None
