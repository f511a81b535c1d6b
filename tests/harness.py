"""Compare a Spark frame with an oracle text on the same Parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(repr(v))
    return v


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def difference(df, con, sql: str) -> str | None:
    """None when both sides hold the same columns and rows, else what differs."""
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = _rows(want_names, cur.fetchall())
    names = df.columns
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(set(names) ^ set(want_names))}"
    got = _rows(names, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {sorted(names)}; got {got[:2]} want {want[:2]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{sorted(names)}\n got {g}\nwant {w}"
    return None
