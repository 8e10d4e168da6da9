"""Run a registered query in Spark and its SQL twin in DuckDB and compare all values."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


PLACES = int(os.environ.get("ORACLE_PLACES", "6"))


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, PLACES) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), PLACES) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, folder):
    """Empty string when equal, else what differs."""
    df = fn(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows(cols, rel.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[:1]} want {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        names = sorted(cols)
        g, w = bad[0]
        diff = [(n, a, b) for n, a, b in zip(names, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ; first {g[:3]} {diff[:4]}"
    return ""
