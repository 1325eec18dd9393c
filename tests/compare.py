"""Runs registered queries against DuckDB over the same parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from featureflow.plans.scenario import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(v[k])}" for k in sorted(v)) + "}"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canon(r[i]) for i in order) for r in rows)


def diff(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    oc, orr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != oc:
        return f"columns {sc} != {oc}"
    if len(sr) != len(orr):
        return f"rows {len(sr)} != {len(orr)}; e.g. {sr[:2]} / {orr[:2]}"
    bad = [(a, b) for a, b in zip(sr, orr) if a != b]
    return f"{len(bad)} of {len(sr)} rows differ in {sc}: {bad[:2]}" if bad else None
