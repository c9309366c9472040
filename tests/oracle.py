"""Runs queries beside their SQL twins and compares rows, schema-blind to column order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def plain(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def difference(spark, con, query, sql: str, d: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, d)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    theirs = [c[0] for c in rel.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    place = [theirs.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {[x for x in got if x not in set(want)][:2]} {[x for x in want if x not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}" if bad else ""
